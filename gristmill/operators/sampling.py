"""Deterministic samples and row estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: str, share: float, n: int, seed: int = 0) -> DataFrame:
    """At most n rows whose md5 of key and seed falls in the first share (in 256ths) of its range: a repeatable Bernoulli, then uniform sample."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return df.withColumn("_h", h).where(F.col("_h") < f"{int(256 * share):02x}").orderBy("_h", key).limit(n).drop("_h")


def half(key, seed: str = "ab"):
    """0 or 1: a stable split by the first byte of a salted md5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 2), 16, 10).cast("int") >= 128).cast("int")


def holdout(key, percent: int = 10, seed: str = "holdout"):
    """True for about percent of the keys, the same ones each time."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent


def estimated_rows(df: DataFrame) -> int | None:
    """The planner's row estimate, without running the query; None where it has none."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return int(rows.get().toString()) if rows.isDefined() else None
