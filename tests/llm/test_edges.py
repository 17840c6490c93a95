"""Every operator on odd rows and on empty tables, with defined results."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gristmill.llm import bpe, chat, decontam, minhash, pages, pii, quality, secrets, topk, toxicity
from gristmill.llm.queries import vocabulary


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_bpe(odd, none):
    out = bpe.encode(odd, vocabulary())
    assert out.count() == odd.count() and out.columns.count("ids") == 1
    back = bpe.decode(out, vocabulary()).select("text", "decoded", "n_tokens").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert [r["n_tokens"] for r in back if not r["text"]] == [0, 0]
    assert bpe.digests(none, vocabulary()).count() == 0


def test_minhash(odd, none):
    got = by_id(minhash.near_duplicates(odd), "n_shingles", "component_id", "kept")
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True)
    assert got[6] == (12, 6, True) and got[7] == (12, 6, False) and got[8][0] == 1
    assert got[None][2] is False
    assert minhash.near_duplicates(odd).count() == odd.count()
    assert minhash.near_duplicates(none).count() == 0


def test_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(6, 0, 1), (9, None, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(odd, labels)
    assert out.count() == odd.count() and all(0 <= r["score"] <= 1 for r in out.collect())
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.scored(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_secrets(odd, none):
    out = secrets.scan(odd, path="source")
    assert {r["doc_id"] for r in out.collect()} <= {5, 8, 9}
    assert secrets.scan(none).count() == 0


def test_quality(odd, none, spark):
    labels = spark.createDataFrame([(6, 1, 0), (4, 0, 0), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.scored(odd, labels, F.col("source"), F.col("lang"))
    assert out.count() == odd.count() and out.where("score is null").count() == 0
    assert quality.scored(none, labels, F.col("source"), F.col("lang")).count() == 0


def test_pii(odd, none):
    got = by_id(pii.spans(odd), "n_email", "n_ip", "n_card", "n_phone", "base")
    assert got[9] == (1, 1, 1, 1, "email:5:20,phone:24:41,card:43:62,ip:66:74")
    assert got[1] == got[5] == (0, 0, 0, 0, "")
    assert pii.spans(odd).count() == odd.count()
    assert pii.spans(none).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.masked(odd.select("doc_id", "text"), pii.spans(odd)).collect()}
    assert masked[9] == "mail [email] or [phone], [card] at [ip]" and masked[1] is None


def test_pages(shipped):
    rows = [(1, None), (2, ""), (3, "<"), (4, "<p>" * 5000 + "deep"), (5, "plain words only"), (6, "<html><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; more</h1><p>Some  text\nhere.</p></article><script>var a='<p>no</p>'</script></body></html>"), (6, "x" * 300_000)]
    df = shipped.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in pages.main_text(df).collect()]
    assert len(got) == len(rows)
    assert (1, "") in got and (2, "") in got and (6, "Head & more\nSome text here.") in got
    assert pages.main_text(df.limit(0)).count() == 0


def test_decontam(odd, none, spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item), (4, "")], "item_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, f"x y {item.upper()}, z"), (21, item), (22, "five six seven eight nine other words here")], "doc_id long, text string"))
    got = sorted((r["doc_id"], r["item_id"], r["start"]) for r in decontam.matches(docs, bench).collect())
    assert got == [(20, 1, 2), (21, 1, 0)]
    assert decontam.matches(none, bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench).count() == docs.count() - 2


def test_topk(shipped):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [-1.0, -1.0]), (None, [9.0, 9.0]), (8, [1.0]), (9, []), (100, [])]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    same = 256 * 256 + 128 * 128
    assert sorted(got[0]) == [(1, 1, same), (2, 1, same), (3, 50, same), (4, 6, 0), (5, 7, -256 * 256 - 128 * 256)]
    assert sorted(got[100]) == [(1, 9, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chat(shipped):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", None), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, 0, None, ""), (5, 0, "user", "a<|im_end|>"), (6, 0, "user", "a<|im_end|>"), (None, 0, "user", "x"), (7, None, "user", "alone")]
    df = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("p", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.collapsed(df).collect()}
    assert set(got) == {2, 4, 5, 7}
    assert got[2][:2] == (3, 1) and got[2][2].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n")
    assert got[5] == (1, 2, "<|im_start|>user\na<| im_end |><|im_end|>\n")
    assert chat.collapsed(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(6, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(name, odd, none, folder, spark):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, folder)
    n = out.count()
    assert n == {"near_duplicates": odd.count() - 2}.get(name, odd.count())
    if name != "bpe":
        assert set(out.columns) >= set(corpus_pipeline.COLUMNS)
    assert stage(spark, none, folder).count() == 0
