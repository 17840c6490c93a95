"""Hand-computed cells of the rollups."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gristmill.operators import rollups

NOW = datetime(2024, 6, 30)
SCHEMA = "id long, company string, category string, posted timestamp, created timestamp, closed timestamp, reason string, duplicate_of long, is_private boolean, countries array<string>"


def ago(days):
    return None if days is None else NOW - timedelta(days=days)


def posting(i, company, created, closed=None, posted=None, dup=None, private=False, category="backend", countries=(), reason="employer_closed"):
    return (i, company, category, ago(posted), ago(created), ago(closed), reason if closed is not None else None, dup, private, list(countries))


def test_running_open(spark):
    rows = [posting(1, "acme", 20), posting(2, "acme", 20, closed=5), posting(3, "acme", 3), posting(4, "acme", 10, dup=1), posting(5, "globex", 15)]
    got = {(r["company"], r["day"]): (r["added"], r["removed"], r["open"]) for r in rollups.company_daily(spark.createDataFrame(rows, SCHEMA)).collect()}
    day = lambda d: (NOW - timedelta(days=d)).date()
    assert got == {("acme", day(20)): (2, 0, 2), ("acme", day(5)): (0, 1, 1), ("acme", day(3)): (1, 0, 2), ("globex", day(15)): (1, 0, 1)}


def test_growth(spark):
    rows = [posting(1, "acme", 40), posting(2, "acme", 3), posting(3, "acme", 3, dup=2), posting(4, "beta", 60), posting(5, "beta", 60, closed=2)]
    got = {r["company"]: (r["open"], r["open_prev"], r["growth"]) for r in rollups.company_growth(spark.createDataFrame(rows, SCHEMA), F.lit(NOW), F.lit(ago(30))).collect()}
    assert got == {"acme": (2, 1, 1), "beta": (1, 2, -1)}


def test_role_country(spark):
    rows = [posting(1, "a", 5, countries=["de", "nl"]), posting(2, "a", 40, countries=["de"]), posting(3, "a", 5, posted=60), posting(4, "a", 5), posting(5, "a", 5, dup=1), posting(6, "a", 5, private=True), posting(7, "a", 40, closed=2, category="design", countries=["us"]), posting(8, "a", 5, category=None)]
    df = spark.createDataFrame(rows, SCHEMA).where("duplicate_of is null and not is_private")
    got = {(r["category"], r["countries"]): (r["open"], r["open_prev"]) for r in rollups.demand(df, ["category"], "countries", F.lit(NOW), F.lit(ago(30))).collect()}
    assert got == {("backend", ""): (4, 2), ("backend", "de"): (2, 1), ("backend", "nl"): (1, 0), ("design", ""): (0, 1), ("design", "us"): (0, 1)}


def test_views(spark):
    rows = [("a", 7, NOW.date()), ("a", 3, ago(29).date()), ("a", 4, ago(35).date()), ("a", 9, ago(70).date()), ("old", 5, ago(90).date())]
    df = spark.createDataFrame(rows, "company string, page_uniques int, day date")
    got = [tuple(r) for r in rollups.windowed_sums(df, "company", "page_uniques", "day", F.lit(NOW.date()), 30).collect()]
    assert got == [("a", 10, 4)]


def test_clusters(spark):
    rows = [(1, "a", "x", None), (2, "a", "x", None), (3, "a", "x", NOW), (4, "a", "y", None), (5, "a", "", None), (6, "a", "", None)]
    got = [tuple(r) for r in rollups.clusters(spark.createDataFrame(rows, "id long, company string, fp string, closed timestamp"), "company", "fp").collect()]
    assert got == [("a", "x", 3, 2)]


def test_salary_tiers(spark):
    rows = [(1, 10, 15, " usd ", "year", 0, 0, "eur", "month"), (2, None, 7, "usd", "", 2_000_000_000, 2_000_000_001, "eur", "month"), (3, None, None, "usd", "year", -1, None, "eur", "month")]
    df = spark.createDataFrame(rows, "id long, a int, b int, c string, p string, a1 int, b1 int, c1 string, p1 string")
    got = {r["id"]: r["s"] for r in df.select("id", rollups.effective_salary([("a", "b", "c", "p"), ("a1", "b1", "c1", "p1")]).alias("s")).collect()}
    assert (float(got[1]["amount"]), got[1]["currency"], got[1]["tier"]) == (12.5, "USD", 0)
    assert (float(got[2]["amount"]), got[2]["tier"]) == (2_000_000_000.5, 1)
    assert got[3] is None


def test_size_series(spark):
    rows = [(date(2024, 1, 1), 10, 0, 0), (date(2024, 1, 2), 0, 0, 1), (date(2024, 1, 3), 5, 3, 2)]
    got = [r["size"] for r in rollups.reconstructed_size(spark.createDataFrame(rows, "day date, added int, removed int, pruned int")).orderBy("day").collect()]
    assert got == [12, 11, 12]


def test_granularity_is_checked(spark):
    with pytest.raises(ValueError):
        rollups.dense_flow(spark.createDataFrame([], "day date, added int, removed int"), "hour", "2024-01-01", "2024-01-02")


def test_lifetime_gate(spark):
    rows = [posting(i, "a", 50, closed=10 + i) for i in range(5)] + [posting(9, "b", 50, closed=10), posting(10, "a", 50, closed=1, reason="swept")]
    got = {r["company"]: (r["n"], r["median_days"]) for r in rollups.lifetime(spark.createDataFrame(rows, SCHEMA), F.lit(NOW)).collect()}
    assert got == {"a": (5, 38.0), "b": (1, None)}
