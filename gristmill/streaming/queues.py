"""Structured Streaming over queues, logs and observations.

Each function takes a streaming frame (or runs one to its end); file sources
keep their place in the checkpoint, so a file is applied once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def drain(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append") -> None:
    """Run a stream over all there is, then stop: into a function of each batch, or into Parquet at a path."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)).start()
    q.awaitTermination()


def latest_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One entry a key: the last by order, whole."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_v")).select(key, "_v.*")


def first_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_v")).select(key, "_v.*")


def claim(queue: DataFrame, now: Column, lease_minutes: int, n: int) -> DataFrame:
    """The n oldest entries that are alive and unclaimed, or whose lease is over."""
    free = F.col("claimed_at").isNull() | (F.timestamp_add("MINUTE", F.lit(lease_minutes), F.col("claimed_at")) < now)
    return queue.where(F.col("failed_at").isNull() & free).orderBy("id").limit(n)


def taken(queue: DataFrame, n: int, key: str = "job_id", at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """The n oldest entries, which leave the queue for good, and the queue without them: no lease, nothing to retry."""
    oldest = queue.orderBy(at, key).limit(n)
    return oldest, queue.join(oldest.select(key), key, "left_anti")


def retried(queue: DataFrame, failed: DataFrame, now: Column, most: int) -> DataFrame:
    """The queue after failures (id, error): an attempt more, the lease given back, and dead at the last attempt."""
    out = queue.join(failed.select("id", F.col("error").alias("_e")), "id", "left")
    hit = F.col("_e").isNotNull()
    tries = F.col("attempts") + F.when(hit, 1).otherwise(0)
    return out.withColumns({"attempts": tries, "claimed_at": F.when(~hit, F.col("claimed_at")), "failed_at": F.when(hit & (tries >= most), now).otherwise(F.col("failed_at")), "last_error": F.coalesce("_e", "last_error")}).drop("_e")


def requeued_owners(changed: DataFrame, roots: DataFrame, key: str, now: Column) -> DataFrame:
    """root, queued_at: the distinct roots of changed rows that are others' duplicates; roots: key, root."""
    return changed.join(roots, key).where(F.col("root") != F.col(key)).select("root").distinct().withColumn("queued_at", now)


def daily_uniques(df: DataFrame, at: str, visitor: str, key: str, late: str = "30 minutes") -> DataFrame:
    """Streaming: one row a (day, visitor, key), however often and in whatever order it comes, until the watermark passes the day."""
    return df.withWatermark(at, late).withColumn("day", F.window(at, "1 day").getField("start").cast("date")).dropDuplicatesWithinWatermark(["day", visitor, key])


def sliding(df: DataFrame, at: str, value: Column, size: str = "10 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Streaming or batch: start, n and total of each sliding window."""
    return df.withWatermark(at, late).groupBy(F.window(at, size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(df: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def observed(df: DataFrame, key: str, at: str) -> DataFrame:
    """Streaming or batch: key, last_seen, n: a monotone state a key (outputMode update or complete)."""
    return df.groupBy(key).agg(F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def grouped_feed(batch: DataFrame, order: str, title: Column, company: str, least: int = 5) -> DataFrame:
    """order, grp, first: rows of a micro-batch grouped by title where at least `least` share it, the rest by company likewise, the others alone.

    first is the place of a group's first row, by which groups are shown.
    """
    rows = batch.withColumn("_t", title)
    rows = rows.withColumn("_nt", F.count(F.lit(1)).over(Window.partitionBy("_t")))
    by_title = F.when(F.col("_nt") >= least, F.concat(F.lit("title:"), F.col("_t")))
    rows = rows.withColumn("_g", by_title)
    rest = F.sum(F.when(F.col("_g").isNull(), 1).otherwise(0)).over(Window.partitionBy(company))
    grp = F.coalesce("_g", F.when(rest >= least, F.concat(F.lit("company:"), F.col(company).cast("string"))), F.concat(F.lit("one:"), F.col(order).cast("string")))
    return rows.select(order, grp.alias("grp")).withColumn("first", F.min(order).over(Window.partitionBy("grp")))


def replay(feed: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows of a feed, oldest first."""
    return feed.orderBy(F.desc(order)).limit(n).orderBy(order)


def change_feed(changes: DataFrame, after: tuple[int, int], horizon: int, n: int) -> DataFrame:
    """The next n changes after the cursor (xid, id) below the horizon; private rows show their closing only."""
    rows = changes.where((F.col("xid") < horizon) & (F.struct("xid", "id") > F.struct(F.lit(after[0]).cast("long").alias("xid"), F.lit(after[1]).cast("long").alias("id"))))
    return rows.where(~F.coalesce(F.col("is_private"), F.lit(False)) | (F.col("kind") == "closed")).orderBy("xid", "id").limit(n)


def cursor_step(consumers: DataFrame, delivered: DataFrame, most: int) -> DataFrame:
    """consumer, cursor, failures, disabled after a round: delivered has consumer, ok, cursor."""
    out = consumers.join(delivered.select("consumer", "ok", F.col("cursor").alias("_c")), "consumer", "left")
    fails = F.when(F.col("ok"), 0).when(~F.col("ok"), F.col("failures") + 1).otherwise(F.col("failures"))
    return out.select("consumer", F.when(F.col("ok"), F.greatest("_c", "cursor")).otherwise(F.col("cursor")).alias("cursor"), fails.alias("failures"), (F.col("disabled") | (fails >= most)).alias("disabled"))


def waves(deletes: DataFrame, upserts: DataFrame, order: str, budget: tuple[int, int]) -> tuple[DataFrame, DataFrame, Callable[[int, int], bool]]:
    """The next waves of deletes and upserts, each within its own budget, and whether to stop by their sizes (both short)."""
    d, u = deletes.orderBy(order).limit(budget[0]), upserts.orderBy(order).limit(budget[1])
    return d, u, lambda nd, nu: nd < budget[0] and nu < budget[1]


def matched_searches(batch: DataFrame, searches: dict[str, Column]) -> DataFrame:
    """search and the batch's rows: every stored filter over every new row, in one pass."""
    hits = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in sorted(searches.items()))), lambda s: s.isNotNull())
    return batch.withColumn("search", F.explode(hits))
