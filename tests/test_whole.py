"""Operators whose queries run over whole tables: prefix filters, quantiles and texts against plain Python."""

import hashlib
import html
import random
import re

import pytest

from gristmill.functions import arrow
from gristmill.operators import resolve, rollups
from gristmill.plans.catalog import QUERIES


@pytest.mark.parametrize("threshold", [0.4, 0.7, 0.8, 1.0])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rnd = random.Random(int(threshold * 10))
    rows = [(i, rnd.choice("ab"), sorted({f"t{int(rnd.expovariate(0.15))}" for _ in range(rnd.randint(0, 12))})) for i in range(160)]
    df = spark.createDataFrame(rows, "k long, b string, t array<string>")
    want = {}
    for i, b, t in rows:
        for j, c, u in rows:
            if i < j and b == c and t and u and len(set(t) & set(u)) / len(set(t) | set(u)) >= threshold:
                want[i, j] = len(set(t) & set(u)) / len(set(t) | set(u))
    got = {(r["a"], r["b"]): r["similarity"] for r in resolve.similar_pairs(df, "k", ["b"], "t", threshold).collect()}
    assert got == pytest.approx(want) and want


def test_common_tokens_come_last(spark, monkeypatch):
    monkeypatch.setattr(resolve, "COMMON", 20)
    test_similar_pairs_equal_brute_force(spark, 0.7)


def test_summaries_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(120):
        full = [f"t{rnd.randint(0, 60)}" for _ in range(rnd.randint(4, 40))]
        rows.append((i, i % 2, sorted(set(full)), [rnd.choice("xyz")]))
    df = spark.createDataFrame(rows, "k long, c long, t array<string>, w array<string>")
    want = {}
    for i, c, t, w in rows:
        for j, d, u, v in rows:
            s = len(set(t) & set(u))
            if i != j and c == d and len(t) <= 0.6 * len(u) and s >= 4 and s >= 0.7 * len(t) and set(w) & set(v):
                want.setdefault(i, []).append(j)
    got = {(r["short"], r["full"]) for r in resolve.summaries(df, "k", "c", "t", "w", 0.7, 4, 0.6).collect()}
    assert got == {(i, js[0]) for i, js in want.items() if len(js) == 1} and got


def test_quantiles_equal_interpolation(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), rnd.choice([None, *range(40)])) for _ in range(300)] + [("d", 7), (None, 3), (None, 5)]
    steps = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {r["g"]: (r["n"], r["quantiles"]) for r in rollups.quantiles(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", steps).collect()}
    for g in {g for g, _ in rows}:
        x = sorted(v for h, v in rows if h == g and v is not None)
        want = [x[int(p)] + (p - int(p)) * (x[min(int(p) + 1, len(x) - 1)] - x[int(p)]) for p in ((len(x) - 1) * q for q in steps)]
        assert got[g][0] == len(x) and got[g][1] == pytest.approx(want)


def test_entities_and_ascii_of_whole_texts(spark, sf):
    got = {(r["kind"], r["id"]): (r["n_chars"], r["md5"]) for r in QUERIES["text_entities"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    assert all(got["page", r["page_id"]] == (len(x := html.unescape(r["html"])), hashlib.md5(x.encode()).hexdigest()) for r in pages)
    assert sum(k == "text" for k, _ in got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_optional_sections_of_long_and_odd_texts(spark):
    body = "word " * 30_000
    texts = [None, "", f"Needs:\n{body}\nNice to have:\nScala\nGo\nOffer:\nmoney\nbonus\nX", "Optional\nall of it\nto the end", "optional words in a line stay"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", arrow.without_optional("t").alias("m")).collect()}
    assert got[0] is None and got[1] == "" and got[4] == texts[4]
    assert got[2] == f"Needs:\n{body}\n" + re.sub(r"[^\n]", " ", "Nice to have:\nScala\nGo\n") + "Offer:\nmoney\n" + re.sub(r"[^\n]", " ", "bonus\nX")
    assert got[3] == re.sub(r"[^\n]", " ", texts[3])
