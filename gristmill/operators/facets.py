"""Facet distributions, disjunctive facets, distinct counts and co-occurrence."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.filters import SearchSpec


def _values(df: DataFrame, facets: list[str], arrays: frozenset[str]) -> Column:
    """Array of (facet, value): every value of every facet once a row; nulls make none."""
    parts = []
    for f in facets:
        values = F.array_distinct(F.transform(f, lambda x: x.cast("string"))) if f in arrays else F.array(F.col(f).cast("string"))
        kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
        parts.append(F.transform(kept, _tag(f)))
    return F.concat(*parts)


def _tag(facet: str):
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))


def distribution(df: DataFrame, facets: list[str], arrays: frozenset[str] = frozenset()) -> DataFrame:
    """facet, value, n: rows that have the value, in one pass over all facets."""
    return df.select(F.explode(_values(df, facets, arrays)).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def disjunctive(df: DataFrame, spec: SearchSpec, facets: list[str]) -> DataFrame:
    """facet, value, n with each facet counted as if its own selection were not made; one pass.

    A row counts towards a facet if it fails no clause, or only that facet's.
    The row (total, "", n) counts the rows that pass everything.
    """
    clauses = {f: c for f in dict.fromkeys([*spec.include, *spec.exclude]) if (c := spec.clause(f)) is not None}
    fails = reduce(add, [(~c).cast("int") for c in clauses.values()], F.lit(0))
    rows = df
    base = SearchSpec(groups=spec.groups).column()
    rows = rows.where(base).withColumn("_fails", fails)
    for i, f in enumerate(facets):
        own = ~clauses[f] if f in clauses else F.lit(False)
        rows = rows.withColumn(f"_ok{i}", (F.col("_fails") == 0) | ((F.col("_fails") == 1) & own))
    parts = [F.when(F.col(f"_ok{i}"), _values(df, [f], spec.arrays)).otherwise(F.array().cast("array<struct<facet:string,value:string>>")) for i, f in enumerate(facets)]
    total = F.when(F.col("_fails") == 0, F.array(F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")))).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))
    return rows.where("_fails <= 1").select(F.explode(F.concat(*parts, total)).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def numeric_stats(df: DataFrame, attributes: list[str]) -> DataFrame:
    """attribute, lo, hi."""
    stack = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in attributes)))
    return df.select(stack.alias("s")).groupBy("s.attribute").agg(F.min("s.v").alias("lo"), F.max("s.v").alias("hi"))


def floored(counts: DataFrame, floor: int, n: str = "n", withheld: int = -1) -> DataFrame:
    """Counts below the floor are withheld."""
    return counts.withColumn(n, F.when(F.col(n) < floor, F.lit(withheld).cast("long")).otherwise(F.col(n)))


def top(counts: DataFrame, k: int, n: str = "n", by: str = "value") -> DataFrame:
    return counts.orderBy(F.desc(n), by).limit(k)


def distinct_and_top(df: DataFrame, key: str, k: int = 50) -> DataFrame:
    """key, n, distinct: the k commonest keys (ties by key) and the exact number of keys."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1))).scalar()
    return counts.orderBy(F.desc("n"), key).limit(k).withColumn("n_distinct", total)


def cooccurrence(pairs: DataFrame, doc: str, item: str, k: int = 24) -> DataFrame:
    """item, neighbour, n, rank: the k items that share most documents with each item, ties by name; pairs are distinct (doc, item) rows."""
    p = pairs.select(F.col(doc).alias("doc"), F.col(item).alias("item")).distinct()
    both = p.join(p.select("doc", F.col("item").alias("neighbour")), "doc").where("item <> neighbour")
    counts = both.groupBy("item", "neighbour").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), "neighbour")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def presence(json: str, attribute: str) -> Column:
    """missing, null, empty or value: how a JSON document has an attribute."""
    raw = F.get_json_object(json, f"$.{attribute}")
    has = F.array_contains(F.json_object_keys(json), attribute)
    return F.when(~F.coalesce(has, F.lit(False)), "missing").when(raw.isNull(), "null").when(raw.isin("", "[]"), "empty").otherwise("value")


def json_values(df: DataFrame, doc: str, json: str, attributes: list[str]) -> DataFrame:
    """doc, attribute, state, str, num: one row a value of the listed attributes; others are ignored.

    Booleans are the strings true and false; numbers are there as text and as number.
    """
    typed = F.from_json(json, "map<string,string>")
    one = lambda a: F.struct(F.lit(a).alias("attribute"), presence(json, a).alias("state"), F.element_at(typed, a).alias("raw"))
    rows = df.select(doc, F.explode(F.array(*(one(a) for a in attributes))).alias("p")).select(doc, "p.*")
    items = F.when(F.col("state") != "value", F.array(F.lit(None).cast("string"))).when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    return rows.withColumn("str", F.explode(items)).withColumn("num", F.col("str").try_cast("double")).select(doc, "attribute", "state", "str", "num")
