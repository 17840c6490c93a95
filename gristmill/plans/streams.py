"""Queries: logs, intervals, queues and streams.

Streaming queries run to the end of their input and are compared with the batch
equivalent in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.operators import intervals, sampling
from gristmill.plans.frames import POSTINGS, postings
from gristmill.plans.registry import query
from gristmill.session import scratch_dir
from gristmill.sources import logs
from gristmill.sources.tables import table
from gristmill.streaming import queues


def _scratch(spark) -> str:
    return f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"


#: Access lines made from events.
LINES = "l AS (SELECT *, '/jobs/' || CAST(event_id % 20 AS VARCHAR) AS path FROM events)"


def _lines(spark, sf):
    k = F.col("event_id")
    path = F.when(k % 4 == 3, F.concat(F.lit("/api/v1/jobs/"), (k % 20).cast("string"))).otherwise(F.concat(F.lit("/jobs/"), (k % 20).cast("string"), F.when(k % 3 == 0, "?utm=1").when(k % 3 == 1, "/__data.json").otherwise(""), F.when(k % 17 == 0, "/similar").otherwise("")))
    agent = F.when(k % 10 == 0, "Googlebot/2.1").when(k % 10 == 1, "CUBOT_X30").when(k % 10 == 2, "somebot").otherwise("Mozilla/5.0")
    status = F.when(k % 7 == 0, "404").otherwise("200")
    line = F.concat(
        F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), path, F.lit(' HTTP/1.1" '), status, F.lit(' 512 "-" "'), agent, F.lit('"'), F.when(k % 13 == 0, ' "prefetch"').otherwise(""),
    )
    return table(spark, sf, "events").select(F.when(k % 50 == 49, "garbage").otherwise(line).alias("value"))


@query("log_uniques", """WITH v AS (SELECT CAST(ts AS DATE) AS day, CAST(event_id % 20 AS VARCHAR) AS slug, user_id || ' ' || CASE event_id % 10 WHEN 0 THEN 'g' WHEN 1 THEN 'c' WHEN 2 THEN 's' ELSE 'm' END AS who, event_id % 4 <> 3 AND event_id % 10 NOT IN (0, 2) AS page, event_id % 4 <> 3 AS open, event_id % 10 IN (0, 2) AS bot
FROM events WHERE event_id % 50 <> 49 AND event_id % 7 <> 0 AND event_id % 13 <> 0 AND (event_id % 17 <> 0 OR event_id % 4 = 3 OR event_id % 3 = 0))
SELECT CAST(day AS VARCHAR) AS day, slug, count(DISTINCT who) AS uniques, count(DISTINCT CASE WHEN page THEN who END) AS page_uniques FROM v WHERE NOT (open AND bot) GROUP BY ALL""")
def _(spark, sf):
    parsed = logs.parse_access(_lines(spark, sf))
    seen = parsed.withColumn("v", logs.viewed(F.col("method"), F.col("path"), F.col("status"), F.col("purpose"))).where("v is not null").select(logs.visitor(F.col("ip"), F.col("agent")).alias("who"), "at", "agent", F.col("v.kind").alias("kind"), F.col("v.slug").alias("slug"))
    # A crawler's pages are no views at all; reads of the API count whoever reads.
    seen = seen.where((F.col("kind") == "api") | ~logs.is_bot(F.col("agent")))
    return logs.daily_viewers(seen, F.to_date("at"), "slug", "who", F.col("kind") == "page").withColumn("day", F.col("day").cast("string"))


@query("log_array_uniques", "WITH v AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, unnest([event_id % 9, event_id % 5, event_id % 9]) AS id FROM events) SELECT CAST(day AS VARCHAR) AS day, id, count(*) AS uniques FROM v GROUP BY ALL")
def _(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("ts", "user_id", F.array(k % 9, k % 5, k % 9).alias("ids"))
    return logs.daily_from_arrays(e, F.to_date("ts"), "user_id", "ids").withColumn("day", F.col("day").cast("string"))


VISITS = "iv AS (SELECT user_id, ts AS s, ts + to_minutes(CAST(30 + event_id % 400 AS INTEGER)) AS e FROM events)"


def _visits(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("ts").alias("start"), F.timestamp_add("MINUTE", (30 + F.col("event_id") % 400).cast("int"), F.col("ts")).alias("end"))


@query("interval_merge", f"""WITH {VISITS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv), g AS (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM m), r AS (SELECT user_id, i, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
SELECT user_id, count(*) AS n, CAST(sum(epoch_us(e) - epoch_us(s)) AS BIGINT) AS us FROM r GROUP BY user_id""")
def _(spark, sf):
    m = intervals.merge(_visits(spark, sf), ["user_id"])
    return m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_micros("end") - F.unix_micros("start")).alias("us"))


@query("interval_clip", f"""WITH {VISITS}, c AS (SELECT user_id, greatest(s, TIMESTAMP '2024-01-10') AS s, least(e, TIMESTAMP '2024-01-12') AS e FROM iv) SELECT user_id, count(*) AS n, CAST(sum(epoch_us(e) - epoch_us(s)) AS BIGINT) AS us FROM c WHERE s < e GROUP BY user_id""")
def _(spark, sf):
    c = intervals.clip(_visits(spark, sf), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_micros("end") - F.unix_micros("start")).alias("us"))


@query("interval_subtract", f"""WITH {VISITS}, w AS (SELECT user_id, s - INTERVAL 10 MINUTE AS s, e + INTERVAL 10 MINUTE AS e FROM iv), u AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-05' AS s, TIMESTAMP '2024-01-20' AS e FROM iv), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
g AS (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM m), b AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, i), x AS (SELECT b.user_id, greatest(b.s, u.s) AS s, least(b.e, u.e) AS e FROM b JOIN u USING (user_id) WHERE greatest(b.s, u.s) < least(b.e, u.e)), t AS (SELECT user_id, sum(epoch_us(e) - epoch_us(s)) AS busy FROM x GROUP BY user_id)
SELECT u.user_id, CAST(epoch_us(u.e) - epoch_us(u.s) - coalesce(busy, 0) AS BIGINT) AS us FROM u LEFT JOIN t USING (user_id) WHERE epoch_us(u.e) - epoch_us(u.s) - coalesce(busy, 0) > 0""")
def _(spark, sf):
    v = _visits(spark, sf)
    free = v.select("user_id").distinct().select("user_id", F.lit("2024-01-05").cast("timestamp").alias("start"), F.lit("2024-01-20").cast("timestamp").alias("end"))
    left = intervals.subtract(free, v, ["user_id"], F.expr("interval 10 minutes"))
    return left.groupBy("user_id").agg(F.sum(F.unix_micros("end") - F.unix_micros("start")).alias("us"))


@query("interval_slices", f"""WITH {VISITS} SELECT user_id, count(*) AS n FROM (SELECT user_id, unnest(generate_series(s, e - INTERVAL 45 MINUTE, INTERVAL 45 MINUTE)) AS s FROM iv) GROUP BY user_id""")
def _(spark, sf):
    return intervals.slices(_visits(spark, sf), 45).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("interval_weekly", """WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-03-25', TIMESTAMP '2024-04-07', INTERVAL 1 DAY)) AS DATE) AS day), r AS (SELECT c_custkey AS key, c_custkey % 5 + 1 AS weekday, 9 AS f, 12 + c_custkey % 3 AS t FROM customer)
SELECT key, strftime(CAST(day AS TIMESTAMP) + to_hours(f - 1), '%Y-%m-%d %H:%M') AS start, strftime(CAST(day AS TIMESTAMP) + to_hours(CAST(t - 1 AS INTEGER)), '%Y-%m-%d %H:%M') AS "end" FROM r JOIN d ON isodow(day) = weekday WHERE NOT (key % 7 = 0 AND day = DATE '2024-04-01') UNION ALL SELECT key, '2024-04-01 13:00', '2024-04-01 15:00' FROM r WHERE key % 14 = 0""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    rules = c.select(k.alias("key"), (k % 5 + 1).cast("int").alias("weekday"), F.lit(9).alias("from_hour"), (12 + k % 3).cast("int").alias("to_hour"), F.lit("+01:00").alias("zone"))
    day = F.lit("2024-04-01").cast("date")
    over = c.where(k % 7 == 0).select(k.alias("key"), day.alias("day"), F.when(k % 14 == 0, 14).alias("from_hour"), F.when(k % 14 == 0, 16).alias("to_hour"))
    out = intervals.weekly(rules, over, "2024-03-25", "2024-04-07")
    return out.select("key", *(F.date_format(x, "yyyy-MM-dd HH:mm").alias(x) for x in ("start", "end")))


@query("interval_partition", """WITH a AS (SELECT user_id, min(ts) AS s, min(ts) + INTERVAL 3 HOUR AS e FROM events GROUP BY 1), b AS (SELECT user_id, s + INTERVAL 1 HOUR AS s, s + INTERVAL 5 HOUR AS e FROM a)
SELECT user_id, 'booked' AS label, CAST(10800 AS BIGINT) AS seconds FROM a UNION ALL SELECT user_id, 'busy', CAST(7200 AS BIGINT) FROM b""")
def _(spark, sf):
    a = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("start")).withColumn("end", F.expr("start + interval 3 hours"))
    b = a.select("user_id", F.expr("start + interval 1 hour").alias("start"), F.expr("start + interval 5 hours").alias("end"))
    parts = intervals.partition([("booked", a), ("busy", b)], ["user_id"])
    return parts.groupBy("user_id", "label").agg(F.sum(F.unix_seconds("end") - F.unix_seconds("start")).alias("seconds"))


@query("stream_daily_uniques", "SELECT CAST(day AS VARCHAR) AS day, event_type, count(*) AS uniques FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events) GROUP BY ALL")
def _(spark, sf):
    path = _scratch(spark)
    s = queues.stream(spark, f"{sf}/events.parque[t]", spark.read.parquet(f"{sf}/events.parquet").schema).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    queues.drain(queues.daily_uniques(s, "ts", "user_id", "event_type"), f"{path}/cp", f"{path}/out")
    rows = spark.read.parquet(f"{path}/out").select("day", "user_id", "event_type").distinct()
    return rows.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("uniques"))


@query("stream_sliding", """WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 9 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS start, event_id FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n, CAST(sum(event_id % 10) AS BIGINT) AS total FROM w GROUP BY 1""")
def _(spark, sf):
    path = _scratch(spark)
    s = queues.stream(spark, f"{sf}/events.parque[t]", spark.read.parquet(f"{sf}/events.parquet").schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    # Complete mode: every window's last state, late windows included.
    queues.drain(queues.sliding(s, "ts", F.col("event_id") % 10), f"{path}/cp", lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out"), "complete")
    return spark.read.parquet(f"{path}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")


@query("stream_sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM l), s AS (SELECT user_id, i, count(*) AS n FROM g GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM s GROUP BY user_id""")
def _(spark, sf):
    out = queues.sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("stream_outbox_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS first_id FROM events GROUP BY user_id")
def _(spark, sf):
    path = _scratch(spark)
    s = queues.stream(spark, f"{sf}/events.parque[t]", spark.read.parquet(f"{sf}/events.parquet").schema).select("user_id", "event_type", "event_id")

    def apply(batch, i):
        queues.latest_wins(batch, "user_id", F.col("event_id")).write.mode("overwrite").parquet(f"{path}/b{i}")
        queues.first_wins(batch, "user_id", F.col("event_id")).write.mode("overwrite").parquet(f"{path}/f{i}")

    queues.drain(s, f"{path}/cp", apply)
    last = queues.latest_wins(spark.read.parquet(f"{path}/b*"), "user_id", F.col("event_id"))
    first = queues.first_wins(spark.read.parquet(f"{path}/f*"), "user_id", F.col("event_id")).select("user_id", F.col("event_id").alias("first_id"))
    return last.join(first, "user_id")


@query("stream_observed", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def _(spark, sf):
    path = _scratch(spark)
    s = queues.stream(spark, f"{sf}/events.parque[t]", spark.read.parquet(f"{sf}/events.parquet").schema).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    queues.drain(queues.observed(s, "user_id", "ts"), f"{path}/cp", lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out"), "complete")
    return spark.read.parquet(f"{path}/out").select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "n")


QUEUE = "q AS (SELECT event_id AS id, user_id AS job_id, event_id % 4 AS attempts, CASE WHEN event_id % 3 = 0 THEN ts END AS claimed_at, CASE WHEN event_id % 11 = 0 THEN ts END AS failed_at FROM events)"


def _queue(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(k.alias("id"), F.col("user_id").alias("job_id"), (k % 4).cast("int").alias("attempts"), F.when(k % 3 == 0, F.col("ts")).alias("claimed_at"), F.when(k % 11 == 0, F.col("ts")).alias("failed_at"), F.lit(None).cast("string").alias("last_error"))


@query("queue_claim", f"WITH {QUEUE} SELECT id, job_id FROM q WHERE failed_at IS NULL AND (claimed_at IS NULL OR claimed_at + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-10') ORDER BY id LIMIT 500")
def _(spark, sf):
    return queues.claim(_queue(spark, sf), F.lit("2024-01-10").cast("timestamp"), 15, 500).select("id", "job_id")


@query("queue_retry", f"""WITH {QUEUE} SELECT id, CAST(attempts + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts, claimed_at IS NOT NULL AND id % 5 <> 0 AS claimed, failed_at IS NOT NULL OR (id % 5 = 0 AND attempts + 1 >= 4) AS dead FROM q""")
def _(spark, sf):
    q = _queue(spark, sf)
    out = queues.retried(q, q.where("id % 5 = 0").select("id", F.lit("boom").alias("error")), F.lit("2024-02-01").cast("timestamp"), 4)
    return out.select("id", F.col("attempts").cast("int").alias("attempts"), F.col("claimed_at").isNotNull().alias("claimed"), F.col("failed_at").isNotNull().alias("dead"))


@query("queue_owner", "SELECT DISTINCT o_orderkey - o_orderkey % 6 AS root FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 6 <> 0")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    roots = o.select("id", (F.col("id") - F.col("id") % 6).alias("root"))
    return queues.requeued_owners(o.where("o_orderstatus = 'P'").select("id"), roots, "id", F.lit("2024-02-01").cast("timestamp")).select("root")


@query("feed_grouped", """WITH b AS (SELECT event_id, user_id, event_type || CAST(event_id % 40 AS VARCHAR) AS t FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY t) AS nt FROM b), r AS (SELECT *, sum(CASE WHEN nt < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS nr FROM n), g AS (SELECT event_id, CASE WHEN nt >= 5 THEN 'title:' || t WHEN nr >= 5 THEN 'company:' || user_id ELSE 'one:' || event_id END AS grp FROM r)
SELECT event_id, grp, min(event_id) OVER (PARTITION BY grp) AS first FROM g""")
def _(spark, sf):
    b = table(spark, sf, "events")
    return queues.grouped_feed(b, "event_id", F.concat("event_type", (F.col("event_id") % 40).cast("string")), "user_id")


@query("change_feed", "SELECT event_id AS id, event_id // 7 AS xid FROM events WHERE (event_id // 7, event_id) > (20, 143) AND event_id // 7 < 900 AND (event_id % 5 <> 0 OR event_type = 'purchase') ORDER BY xid, id LIMIT 300")
def _(spark, sf):
    k = F.col("event_id")
    c = table(spark, sf, "events").select(k.alias("id"), F.floor(k / 7).alias("xid"), F.when(F.col("event_type") == "purchase", "closed").otherwise("seen").alias("kind"), (k % 5 == 0).alias("is_private"))
    return queues.change_feed(c, (20, 143), 900, 300).select("id", "xid")


@query("feed_replay", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 64")
def _(spark, sf):
    return queues.replay(table(spark, sf, "events").select("event_id"), "event_id", 64)


@query("webhook_cursor", "WITH c AS (SELECT c_custkey AS consumer, c_custkey % 9 AS cursor, CAST(c_custkey % 4 AS INTEGER) AS failures FROM customer) SELECT consumer, CASE WHEN consumer % 3 = 0 THEN greatest(5, cursor) ELSE cursor END AS cursor, CASE consumer % 3 WHEN 0 THEN 0 WHEN 1 THEN failures + 1 ELSE failures END AS failures, CASE consumer % 3 WHEN 0 THEN false WHEN 1 THEN failures + 1 >= 3 ELSE failures >= 3 END AS disabled FROM c")
def _(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("consumer"), (k % 9).alias("cursor"), (k % 4).cast("int").alias("failures"), F.lit(False).alias("disabled"))
    d = c.where("consumer % 3 <> 2").select("consumer", (F.col("consumer") % 3 == 0).alias("ok"), F.lit(5).cast("long").alias("cursor"))
    return queues.cursor_step(c, d, 3)


@query("search_digest", "SELECT 'big' AS search, count(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'both', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000")
def _(spark, sf):
    big, urgent = F.col("o_totalprice") > 400000, F.col("o_orderpriority") == "1-URGENT"
    return queues.matched_searches(table(spark, sf, "orders"), {"big": big, "urgent": urgent, "both": big & urgent}).groupBy("search").agg(F.count(F.lit(1)).alias("n"))


@query("queue_progress", "SELECT event_type, greatest(0, least(count(*) FILTER (WHERE event_id % 3 = 0), 500)) AS covered, round(count(*) / 12.0 * 60, 6) AS eta_seconds FROM events GROUP BY event_type")
def _(spark, sf):
    from gristmill.operators.match import progress

    g = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 == 0).alias("done"), F.count(F.lit(1)).alias("depth"))
    return g.select("event_type", progress(F.lit(500).cast("long"), F.col("done"), F.col("depth"), F.lit(12.0)).alias("p")).select("event_type", "p.covered", F.round("p.eta_seconds", 6).alias("eta_seconds"))


@query("row_estimate")
def _(spark, sf):
    """The planner's estimate beside the exact count; the estimate has no SQL."""
    o = table(spark, sf, "orders")
    n = sampling.estimated_rows(o.where("o_orderstatus = 'F'"))
    return o.where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("o_custkey").alias("customers")).withColumn("estimate", F.lit(n).cast("long"))


@query("queue_taken", f"""WITH {POSTINGS}, q AS (SELECT DISTINCT event_id * 3 AS job_id, ts AS created_at FROM events), c AS (SELECT job_id FROM q ORDER BY created_at, job_id LIMIT 500)
SELECT 'shown' AS part, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS ids FROM c JOIN p ON p.id = job_id WHERE closed IS NULL AND duplicate_of IS NULL AND NOT is_private UNION ALL SELECT 'left', count(*), CAST(sum(job_id) AS BIGINT) FROM q WHERE job_id NOT IN (SELECT job_id FROM c)""")
def _(spark, sf):
    """The feed's oldest 500 entries leave the queue; those that are listed are shown."""
    from gristmill.functions.predicates import listed

    q = table(spark, sf, "events").select((F.col("event_id") * 3).alias("job_id"), F.col("ts").alias("created_at"))
    oldest, rest = queues.taken(q, 500)
    shown = oldest.join(postings(spark, sf).where(F.col("closed").isNull() & listed()).select(F.col("id").alias("job_id")), "job_id")
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.sum("job_id").alias("ids")).select(F.lit(name).alias("part"), "n", "ids")
    return part(shown, "shown").unionByName(part(rest, "left"))
