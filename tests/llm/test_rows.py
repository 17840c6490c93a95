"""Rows with null and repeated ids: each is checked, masked and kept by its own text."""

import corpus_pipeline
import pytest

ITEM = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "a calm river runs past seven old mills and nobody counts the boats"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def staged(name, spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, folder).collect()), key=str)


def test_masking_by_row(shipped, folder):
    rows = [(None, "mail bob@example.com now"), (None, "no data"), (1, "write to ann@example.com"), (1, "at 10.0.0.1 today"), (1, "nothing here"), (2, None)]
    want = [(None, "mail [email] now"), (None, "no data"), (1, "write to [email]"), (1, "at [ip] today"), (1, "nothing here"), (2, None)]
    assert staged("personal_data", shipped, folder, rows) == sorted(want, key=str)


def test_contamination_by_row(shipped, folder):
    rows = [(None, f"x {ITEM} y"), (None, OTHER), (1, ITEM), (1, OTHER), (2, None)]
    assert staged("decontamination", shipped, folder, rows) == sorted([(None, OTHER), (1, OTHER), (2, None)], key=str)


def test_near_duplicates_by_row(shipped, folder):
    rows = [(1, ITEM), (1, OTHER), (1, OTHER), (2, ITEM), (0, "quite another text of its own that nobody else has"), (3, ""), (3, None), (None, OTHER)]
    want = [(1, ITEM), (1, OTHER), (0, rows[4][1]), (3, ""), (3, None), (None, OTHER)]
    assert staged("near_duplicates", shipped, folder, rows) == sorted(want, key=str)
