import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import facets, filters
from gristmill.operators.filters import Alternative, SearchSpec


def test_query_syntax():
    assert filters.parse_query("go or rust") == [Alternative("go or rust")]
    assert filters.parse_query('go OR "a OR b" OR title:lead') == [Alternative("go"), Alternative('"a OR b"'), Alternative("lead", ("title",))]
    assert len(filters.parse_query(" OR ".join("abcdefgh"))) == 5


def test_box_operators():
    assert filters.parse_box('company:"Acme Inc" go source:lever what:ever') == ({"company": ["Acme Inc"], "source": ["lever"]}, "go what:ever")


def test_canonical_queries():
    a = filters.canonical_query({"skills": ["go,rust"], "sort": ["new"], "x": [""]})
    assert a == filters.canonical_query({"skills": ["rust", "go"]}) == {"skills": ["go", "rust"]}


def test_parameters():
    assert filters.ignored_params({"a": ["1"], "b": ["x", "y"]}, {"b": {"x"}}) == ["a", "b=y"]
    assert filters.bounded_int("7", 1, 5, 3) == (3, True) and filters.bounded_int("4", 1, 5, 3) == (4, False) and filters.bounded_int("z", 1, 5, 3) == (3, True)
    assert filters.comma_terms(" a, ,b,c", 2) == ["a", "b"]


def test_bounds(spark):
    assert filters.bounded("n", "-1") == [] and filters.bounded("n", "abc") == [] and len(filters.bounded("n", "0")) == 1
    assert filters.all_of([[], []]) is None and filters.ids_in("id", []) == []


def test_exclusion_passes_absent(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string")
    assert [r[0] for r in df.where(filters.excludes("s", "a")).select("id").orderBy("id").collect()] == [2, 3]


def test_open_guard_accepts_documents_without_markers(spark):
    df = spark.createDataFrame([(1, None, None), (2, True, False), (3, False, False), (4, False, True)], "id int, is_closed boolean, is_duplicate boolean")
    assert [r[0] for r in df.where(filters.all_of(filters.open_only([]))).select("id").orderBy("id").collect()] == [1, 3]


def test_family(spark):
    df = spark.createDataFrame([("whatjobs",)] * 5 + [(" WhatJobs-br",)] * 3 + [("whatjobs-de",)] * 2 + [("lever",)] * 7, "s string")
    got = {r["f"]: r["count"] for r in df.groupBy(filters.family(F.col("s"), ("whatjobs",)).alias("f")).count().collect()}
    assert got == {"whatjobs": 10, "lever": 7}


def test_disjunctive_equals_separate_queries(spark):
    rows = [(i, "ab"[i % 2], ["x", "y", "z"][: i % 4], "mn"[i % 3 > 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, c string, s array<string>, w string")
    spec = SearchSpec(include={"c": ["a"], "s": ["x", "z"]}, exclude={"w": ["n"]}, arrays=frozenset({"s"}))
    got = {(r["facet"], r["value"]): r["n"] for r in facets.disjunctive(df, spec, ["c", "s", "w"]).collect()}
    g = {"c": lambda r: r[1] == "a", "s": lambda r: bool({"x", "z"} & set(r[2])), "w": lambda r: r[3] != "n"}
    want = {}
    for f, values in (("c", lambda r: [r[1]]), ("s", lambda r: r[2]), ("w", lambda r: [r[3]])):
        for r in rows:
            if all(p(r) for k, p in g.items() if k != f):
                for v in values(r):
                    want[f, v] = want.get((f, v), 0) + 1
    if n := sum(all(p(r) for p in g.values()) for r in rows):
        want["total", ""] = n
    assert got == want


def test_distinct_counts(spark):
    df = spark.createDataFrame([(i,) for i in range(7) for _ in range(i + 1)], "company int")
    got = facets.distinct_and_top(df, "company", 3).collect()
    assert [(r["company"], r["n"], r["n_distinct"]) for r in got] == [(6, 7, 7), (5, 6, 7), (4, 5, 7)]


def test_presence_is_four_valued(spark):
    docs = [(1, {}), (2, {"a": None}), (3, {"a": []}), (4, {"a": ""}), (5, {"a": ["u", "v"]}), (6, {"a": 7}), (7, {"a": True})]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id int, doc string")
    got = [(r["id"], r["state"], r["str"], r["num"]) for r in facets.json_values(df, "id", "doc", ["a"]).orderBy("id", "str").collect()]
    assert got == [(1, "missing", None, None), (2, "null", None, None), (3, "empty", None, None), (4, "empty", None, None), (5, "value", "u", None), (5, "value", "v", None), (6, "value", "7", 7.0), (7, "value", "true", None)]


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1-")).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "StringStartsWith" in plan
    assert "o_totalprice" not in plan


@pytest.mark.parametrize("name", ["facet_disjunctive", "filter_cnf", "asof_day", "dedup_twins", "join_domain_suffix"])
def test_no_cross_products(name, spark, sf):
    from gristmill.plans.catalog import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
