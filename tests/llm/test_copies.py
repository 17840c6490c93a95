"""Near duplicates of rows that share ids, against brute force by rows, and keys with many rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from gristmill.llm import minhash


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row; a row is a document of its own."""
    sets = []
    for _, t in rows:
        w = t.encode().lower().split() if t else []
        sets.append(frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and rows[a][0] is not None and rows[b][0] is not None and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[top(k)].append(i)
    return sorted((i, len(sets[k]), min(least[top(k)])) for k, (i, _) in enumerate(rows) if i is not None)


def near(words, k):
    return " ".join([*words[:-1], f"other{k}"])


def test_rows_that_share_an_id(shipped):
    rnd = random.Random(8)
    a, b, c = ([f"{x}{rnd.randint(0, 300)}" for _ in range(60)] for x in "abc")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a, 1)), (8, near(b, 1)), (3, near(b, 2)), (9, " ".join(c)), (9, " ".join(c)), (2, near(c, 1)), (2, near(a, 2)), (4, None), (4, ""), (6, "one two")]
    df = shipped.createDataFrame([*rows, (None, near(c, 3)), (None, " ".join(a)), (None, None)], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(rows)
    assert sorted(((r["component_id"], r["kept"]) for r in got if r["doc_id"] is None), key=str) == sorted([(None, False), (2, False), (None, False)], key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_keys_with_many_rows(shipped, monkeypatch):
    """With pieces of four rows every bucket, family, component and class of copies is dealt over several."""
    monkeypatch.setattr(minhash, "HOT_ROWS", 4)
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(60)]
    rows = [(500 + k, " ".join(base)) for k in range(40)] + [(i, "") for i in range(20)]
    for k in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"new{rnd.randint(0, 50)}"
        rows.append((100 + k, " ".join(w)))
    got = minhash.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string"))
    wanted = [(i, n, i if n == 0 else c) for i, n, c in brute(rows)]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == wanted


def test_dealt_join_keeps_rows(shipped, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_ROWS", 10)
    rows = shipped.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(-7)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id")
    facts = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    out = minhash.dealt_join(rows, facts, "k", "id", 1000, "left").orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(1000))
    assert all(r["most"] == (999 if r["id"] % 3 == 0 else r["id"] if r["id"] % 3 == 1 else None) for r in out)
