"""The whole pipeline against plain Python, stage by stage."""

import hashlib
import random
import struct

import corpus_pipeline
from tokenizers import Tokenizer

from gristmill.llm import toxicity
from gristmill.llm.queries import vocabulary


def near(a, b):
    cut = lambda t: {tuple(t.lower().split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    x, y = cut(a), cut(b)
    return 100 * len(x & y) >= 80 * len(x | y) and bool(x | y)


def test_run_equals_plain_python(shipped, tmp_path):
    rnd = random.Random(21)
    words = ["".join(rnd.choice("aeioubdklmnrst") for _ in range(rnd.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        t = text(rnd.randint(40, 90))
        if i % 8 == 0:
            t = f"{t} zorgblat vexquim zorgblats"
        docs.append((i, t, "en", "s"))
        labels.append((i, 1, int(i % 8 == 0)))
    item = text(40)
    plain = [t for i, t, _, _ in docs if i % 8]
    for k in range(12):
        parts = plain[k].split()
        parts[5] = f"changed{k}"
        docs.append((300 + k, " ".join(parts), "en", "s"))
    docs += [(400, f"{text(20)} {item} {text(9)}", "en", "s"), (401, item.upper(), "en", "s")]
    masked = {500: ("write to ann.b@example.com or +49 30 5551234", "write to [email] or [phone]"), 501: ("host 10.0.0.1 is up", "host [ip] is up"), 502: (None, None), 503: ("", ""), 504: ("a <|endoftext|> b", "a <|endoftext|> b")}
    docs += [(i, t, "en", "s") for i, (t, _) in masked.items()] + [docs[1], (1, "quite another text of its own", "en", "s"), (None, docs[2][1], "en", "s")]
    folder = str(tmp_path)
    shipped.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    shipped.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    shipped.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = [d for d in dict.fromkeys(docs) if "zorgblat" not in (d[1] or "")]
    withid = [d for d in kept if d[0] is not None]
    group = {d: d for d in withid}
    for a in withid:
        for b in withid:
            if a[1] and b[1] and near(a[1], b[1]):
                least = min(group[a], group[b], key=lambda d: d[0])
                for d in withid:
                    if group[d] in (group[a], group[b]):
                        group[d] = least
    kept = [d for d in kept if d[0] is None or group[d] == d]
    kept = [d for d in kept if item not in (d[1] or "").lower()]
    library, want = Tokenizer.from_file(vocabulary()), []
    for i, t, _, _ in kept:
        t = masked[i][1] if i in masked else t
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(shipped, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert toxicity.SAMPLE >= len(labels) and len(want) > 180
