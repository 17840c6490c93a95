"""Streams over files: once each, in any order, with late rows."""

from datetime import datetime

from pyspark.sql import functions as F

from gristmill.operators import intervals, joins
from gristmill.streaming import queues

SCHEMA = "ts timestamp, user_id long, event_type string"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_files_are_applied_once(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    put(spark, src, "a", [(datetime(2024, 1, 1, 5), 1, "view"), (datetime(2024, 1, 1, 6), 1, "view"), (datetime(2024, 1, 1, 7), 2, "view")])
    run = lambda: queues.drain(queues.daily_uniques(queues.stream(spark, f"{src}/*", SCHEMA), "ts", "user_id", "event_type"), cp, out)
    run()
    assert spark.read.parquet(out).count() == 2
    run()  # nothing new
    assert spark.read.parquet(out).count() == 2
    put(spark, src, "b", [(datetime(2024, 1, 1, 7, 20), 2, "view"), (datetime(2024, 1, 1, 7, 30), 3, "view")])
    run()
    assert spark.read.parquet(out).count() == 3


def test_observations_are_monotone(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, "a", [(datetime(2024, 1, 3), 1, "x")])
    put(spark, src, "b", [(datetime(2024, 1, 2), 1, "x"), (datetime(2024, 1, 1), 2, "x")])
    seen = {}
    queues.drain(queues.observed(queues.stream(spark, f"{src}/*", SCHEMA), "user_id", "ts"), str(tmp_path / "cp"), lambda b, i: seen.update({r["user_id"]: r["last_seen"] for r in b.collect()}), "update")
    assert seen == {1: datetime(2024, 1, 3), 2: datetime(2024, 1, 1)}


def test_latest_and_first_win(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, None), (2, 1, "c")], "k long, seq long, v string")
    assert {r["k"]: (r["seq"], r["v"]) for r in queues.latest_wins(df, "k", F.col("seq")).collect()} == {1: (7, None), 2: (1, "c")}
    assert {r["k"]: r["v"] for r in queues.first_wins(df, "k", F.col("seq")).collect()} == {1: "a", 2: "c"}


def test_precedence_of_layers(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    frame = lambda rows: spark.createDataFrame([(1, at(a), at(b)) for a, b in rows], "k long, start timestamp, end timestamp")
    parts = intervals.partition([("booked", frame([(10, 11)])), ("busy", frame([(9, 12)])), ("free", frame([(8, 14), (16, 17)]))], ["k"])
    got = [(r["start"].hour, r["end"].hour, r["label"]) for r in parts.orderBy("start").collect()]
    assert got == [(8, 9, "free"), (9, 10, "busy"), (10, 11, "booked"), (11, 12, "busy"), (12, 14, "free"), (14, 16, None), (16, 17, "free")]


def test_merge_touching(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 8), (1, 2, 4)], "k long, start int, end int")
    assert sorted((r["start"], r["end"]) for r in intervals.merge(df, ["k"]).collect()) == [(1, 5), (7, 8)]


def test_asof_without_and_with_keys(spark):
    left = spark.createDataFrame([(i,) for i in range(10)], "x long")
    right = spark.createDataFrame([(3, "a"), (6, "b"), (6, "c")], "m long, v string")
    got = [(r["x"], r["m"], r["v"]) for r in joins.asof(left, right, "x", "m", ["v"], slices=4).orderBy("x").collect()]
    assert got == [(x, None if x < 3 else 3 if x < 6 else 6, None if x < 3 else "a" if x < 6 else "c") for x in range(10)]
    keyed = joins.asof(left.withColumn("g", F.col("x") % 2), right.withColumn("g", F.lit(1).cast("long")), "x", "m", ["v"], by=["g"])
    assert [r["m"] for r in keyed.orderBy("x").collect()] == [None, None, None, 3, None, 3, None, 6, None, 6]


def test_climb_stops_at_depth_and_gaps(spark):
    df = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, 12)] + [(50, 49)], "id long, up long")
    got = {r["id"]: r["root"] for r in joins.climb(df, "id", "up", 8).collect()}
    assert got[5] == 0 and got[8] == 0 and got[11] == 3 and got[50] == 50
