"""Interval algebra on (key, start, end) frames, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(df: DataFrame, w0: Column, w1: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Intersection with [w0, w1); empty ranges go."""
    out = df.withColumn(start, F.greatest(F.col(start), w0)).withColumn(end, F.least(F.col(end), w1))
    return out.where(F.col(start) < F.col(end))


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching ranges of each key as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col(start), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def partition(layers: list[tuple[str, DataFrame]], keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end, label: elementary ranges between all bounds of a key, labelled by the first layer that covers them; uncovered ones have a null label.

    Each range gives a +1 and a -1 event; running sums over one window tell what
    covers the stretch up to the next bound.
    """
    events = None
    for i, (_, df) in enumerate(layers):
        steps = [F.lit(1 if j == i else 0) for j in range(len(layers))]
        e = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("s")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("s")))).alias("e"))
        e = e.select(*keys, F.col("e.at").alias("at"), *((F.col("e.s") * st).alias(f"_{j}") for j, st in enumerate(steps)))
        events = e if events is None else events.unionByName(e)
    bounds = events.groupBy(*keys, "at").agg(*(F.sum(f"_{j}").alias(f"_{j}") for j in range(len(layers))))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    label = F.lit(None).cast("string")
    for j, (name, _) in reversed(list(enumerate(layers))):
        label = F.when(F.sum(f"_{j}").over(run) > 0, F.lit(name)).otherwise(label)
    out = bounds.select(*keys, F.col("at").alias(start), F.lead("at").over(w).alias(end), label.alias("label"))
    return out.where(F.col(end).isNotNull())


def subtract(free: DataFrame, busy: DataFrame, keys: list[str], margin: Column | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Free time minus busy time (widened by the margin, a day-time interval), as maximal ranges."""
    if margin is not None:
        busy = busy.withColumn(start, F.col(start) - margin).withColumn(end, F.col(end) + margin)
    parts = partition([("busy", busy.select(*keys, start, end)), ("free", free.select(*keys, start, end))], keys, start, end)
    return merge(parts.where("label = 'free'").drop("label"), keys, start, end)


def weekly(rules: DataFrame, overrides: DataFrame, first: str, last: str) -> DataFrame:
    """key, start, end in UTC of weekly rules (key, weekday 1 = Monday, from_hour, to_hour, zone) over the days [first, last]; an override (key, day, from_hour, to_hour, null for a day off) replaces the whole day."""
    days = rules.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}')")).alias("day"))
    by_rule = days.withColumn("weekday", F.weekday("day") + 1).join(rules, "weekday")  # seven weekdays
    zones = rules.select("key", "zone").distinct()
    kept = by_rule.join(overrides.select("key", "day").distinct(), ["key", "day"], "left_anti").select("key", "day", "from_hour", "to_hour", "zone")
    changed = overrides.join(zones, "key").where("from_hour is not null").select("key", "day", "from_hour", "to_hour", "zone")
    at = lambda h: F.to_utc_timestamp(F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col(h)), F.col("zone"))
    return kept.unionByName(changed).select("key", at("from_hour").alias("start"), at("to_hour").alias("end"))


def slices(df: DataFrame, minutes: int, start: str = "start", end: str = "end") -> DataFrame:
    """Slots of a fixed length that fit into the ranges, from each range's start on."""
    step = F.expr(f"interval {minutes} minutes")
    fits = F.col(end) - step >= F.col(start)
    first = F.when(fits, F.sequence(F.col(start), F.col(end) - step, step))
    return df.withColumn(start, F.explode(first)).withColumn(end, F.col(start) + step)
