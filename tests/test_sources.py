import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.functions import arrow, times
from gristmill.functions import text as tx
from gristmill.operators import resolve
from gristmill.sources import logs, publish
from gristmill.streaming import queues


def test_publish_is_atomic(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        publish.current(spark, path)
    for n in (3, 5, 7):
        publish.publish(spark.range(n), path, keep=2)
    assert publish.current(spark, path).count() == 7
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2


def test_export_day_is_immutable(spark, tmp_path):
    path = str(tmp_path)
    m = publish.export_day(spark.range(10), path, "2024-01-01", "id")
    assert m["rows"] == 10 and m["last"] == "9"
    with pytest.raises(FileExistsError):
        publish.export_day(spark.range(1), path, "2024-01-01", "id")
    (tmp_path / "2024-01-02").mkdir()  # no manifest: not listed
    assert publish.published_days(spark, path) == ["2024-01-01"]
    publish.export_day(spark.range(2), path, "2024-01-03", "id")
    assert publish.published_days(spark, path, keep=1) == ["2024-01-03"]


def test_event_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"viewer":"u","job_ids":[1,2]}\nnot json\n')
    good, counts = logs.read_events(spark, str(tmp_path / "a.jsonl"), "viewer string, job_ids array<long>")
    assert good.count() == 1 and tuple(counts.first()) == (1, 1)
    logs.checked(counts)
    (tmp_path / "b.jsonl").write_text("no\n")
    with pytest.raises(ValueError):
        logs.checked(logs.read_events(spark, str(tmp_path / "b.jsonl"), "viewer string")[1])


def test_access_lines(spark, tmp_path):
    import gzip

    line = '1.2.3.4 - - [01/Jan/2024:10:00:00 +0200] "GET /jobs/x-1?a=b HTTP/1.1" 200 5 "-" "Mozilla"'
    with gzip.open(tmp_path / "access.log.gz", "wt") as f:
        f.write(line + "\n" + line + ' "prefetch"\nbroken\n')
    rows = logs.read_access(spark, str(tmp_path)).withColumn("v", logs.viewed(F.col("method"), F.col("path"), F.col("status"), F.col("purpose"))).collect()
    assert len(rows) == 2 and {r["v"]["slug"] if r["v"] else None for r in rows} == {"x-1", None}
    assert rows[0]["at"] == datetime(2024, 1, 1, 8)


def test_lists(spark):
    rows = spark.createDataFrame([("# note",), ("acme",), ("",)], "value string")
    assert [r["name"] for r in logs.list_records(rows, "slugs").collect()] == ["acme"]
    rows = spark.createDataFrame([(json.dumps({"name": "Über GmbH"}),)], "value string")
    assert [tuple(r) for r in logs.list_records(rows, "json").collect()] == [("Über GmbH", "uber-gmbh")]
    with pytest.raises(ValueError):
        logs.list_records(rows, "other")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_titles(spark):
    assert one(spark, tx.strip_clause(tx.role_text(F.lit("<b>Senior  Engineer</b>, Krakow")))) == "senior engineer"
    assert one(spark, tx.strip_clause(F.lit("engineer - remote"))) == "engineer - remote"
    assert one(spark, resolve.decorated_key(F.lit("Guest Service Agent: Front Office - Days"))) == "guest service agent"
    assert one(spark, resolve.decorated_key(F.lit("Guest Service Agent (Front), Nights"))) == "guest service agent (front), nights"
    assert one(spark, tx.suggestion_title(F.lit("– Go Developer – Berlin"))) == "go developer"
    assert one(spark, tx.fold_term(F.lit("R&D—Ёлка"))) == "r and d елка"


def test_subset_twins(spark):
    a = [(1, "c", "Guest Service Agent", []), (2, "c", "Software Engineer", ["de"]), (3, "d", "Software Engineer", ["de"])]
    b = [(10, "c", "Guest Service Agent Front Office", ["us"]), (11, "c", "Senior Software Engineer", ["de"]), (12, "d", "Software Engineer Payments", ["fr"])]
    schema = "id long, company string, title string, countries array<string>"
    got = [tuple(r) for r in resolve.twins(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()]
    assert got == [(1, 10, "subset")]


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in df.select(tx.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 0.0]
    assert one(spark, tx.signature(F.lit("The café has 4444 wood"))) == ["4444", "wood"]


def test_urls(spark):
    assert one(spark, tx.domain(F.lit("https://user@WWW.Acme.com.:443/x"))) == "acme.com"
    assert one(spark, tx.domain(F.lit("localhost"))) is None
    assert one(spark, tx.untagged_url(F.lit("https://a.b/x?utm_source=gm&k=1#f"))) == "https://a.b/x?k=1#f"
    assert one(spark, tx.untagged_url(F.lit("https://a.b/x?utm_source=gm"))) == "https://a.b/x"


def test_times(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert one(spark, times.parsed(F.lit("2025-01-01"), now)) is None
    assert one(spark, times.whole_days(now, F.lit("2024-01-08 00:00:01").cast("timestamp"))) == 1
    assert one(spark, times.in_quiet_hours(now, F.lit("UTC"), F.lit(22), F.lit(6))) is True


def test_arrow_functions(spark):
    assert one(spark, arrow.transliterated(F.lit("Łódź Straße"))) == "odz Strasse" or one(spark, arrow.transliterated(F.lit("łódź Straße"))) == "lodz Strasse"
    pieces = one(spark, arrow.chunks(F.lit("para one\n\n" + "word " * 30 + "x" * 50), 40))
    assert all(len(p) <= 40 for p in pieces) and "".join(pieces).replace(" ", "").replace("\n", "") == ("para one" + "word " * 30 + "x" * 50).replace(" ", "")
    assert one(spark, arrow.language(F.lit("der Hund und die Katze sind nicht in dem Haus von Anna"))) == "de"
    assert one(spark, arrow.language(F.lit("short"))) == ""


def test_feed_groups(spark):
    rows = [(i, "go dev", f"c{i}") for i in range(5)] + [(10 + i, f"t{i}", "acme") for i in range(5)] + [(20, "x", "solo")]
    got = {r["id"]: r["grp"] for r in queues.grouped_feed(spark.createDataFrame(rows, "id long, t string, company string"), "id", F.col("t"), "company").collect()}
    assert got[0] == "title:go dev" and got[11] == "company:acme" and got[20] == "one:20"


def test_waves(spark):
    d, u, stop = queues.waves(spark.range(3), spark.range(100), "id", (5, 10))
    assert (d.count(), u.count()) == (3, 10) and not stop(3, 10) and stop(3, 4)


def test_library_stands_without_the_subpackage():
    import pathlib

    top = pathlib.Path(__file__).parent.parent / "gristmill"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "gristmill.llm" in p.read_text()]
