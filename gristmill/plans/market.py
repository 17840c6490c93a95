"""Queries: rollups, windows and joins over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import joins, rollups
from gristmill.plans.frames import BEFORE, NOW, POSTINGS, SKILLS, WITH_COUNTRY, postings, skills, with_country
from gristmill.plans.registry import query
from gristmill.sources.tables import table

def _at(day: str):
    return F.lit(day).cast("timestamp")


def _open(day: str) -> str:
    return f"(least(posted, created) <= TIMESTAMP '{day}' AND (closed IS NULL OR closed > TIMESTAMP '{day}'))"


CANON = "duplicate_of IS NULL AND NOT is_private"
REAL = "closed IS NOT NULL AND reason IN ('employer_closed', 'feed_removed', 'probe_expired', 'unseen')"
FLOW = "a AS (SELECT CAST(created AS DATE) AS day, count(*) AS added FROM p GROUP BY 1), r AS (SELECT CAST(closed AS DATE) AS day, count(*) AS removed FROM p WHERE closed IS NOT NULL GROUP BY 1)"


@query("daily_flow", f"WITH {POSTINGS}, {FLOW} SELECT CAST(coalesce(a.day, r.day) AS VARCHAR) AS day, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(removed, 0) AS BIGINT) AS removed FROM a FULL JOIN r ON a.day = r.day")
def _(spark, sf):
    return rollups.daily_flow(postings(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("daily_flow_full_join", f"WITH {POSTINGS}, {FLOW} SELECT CAST(coalesce(a.day, r.day) AS VARCHAR) AS day, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(removed, 0) AS BIGINT) AS removed FROM a FULL JOIN r ON a.day = r.day")
def _(spark, sf):
    p = postings(spark, sf)
    a = p.groupBy(F.to_date("created").alias("day")).agg(F.count(F.lit(1)).alias("added"))
    r = p.where("closed is not null").groupBy(F.to_date("closed").alias("day")).agg(F.count(F.lit(1)).alias("removed"))
    return a.join(r, "day", "full").fillna(0).withColumn("day", F.col("day").cast("string"))


@query("flow_by_month", f"""WITH {POSTINGS}, {FLOW}, f AS (SELECT coalesce(a.day, r.day) AS day, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM a FULL JOIN r ON a.day = r.day),
c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-06-30', INTERVAL 1 MONTH)) AS DATE) AS period)
SELECT CAST(period AS VARCHAR) AS period, CAST(coalesce(sum(added), 0) AS BIGINT) AS added, CAST(coalesce(sum(removed), 0) AS BIGINT) AS removed FROM c LEFT JOIN f ON date_trunc('month', f.day) = period AND f.day BETWEEN DATE '1996-01-10' AND DATE '1997-06-30' GROUP BY period""")
def _(spark, sf):
    return rollups.dense_flow(rollups.daily_flow(postings(spark, sf)), "month", "1996-01-10", "1997-06-30").withColumn("period", F.col("period").cast("string"))


@query("flow_by_week", f"""WITH {POSTINGS}, {FLOW}, f AS (SELECT coalesce(a.day, r.day) AS day, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM a FULL JOIN r ON a.day = r.day),
c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-03-02', TIMESTAMP '1998-08-31', INTERVAL 7 DAY)) AS DATE) AS period)
SELECT CAST(period AS VARCHAR) AS period, CAST(coalesce(sum(added), 0) AS BIGINT) AS added, CAST(coalesce(sum(removed), 0) AS BIGINT) AS removed FROM c LEFT JOIN f ON date_trunc('week', f.day) = period AND f.day BETWEEN DATE '1998-03-04' AND DATE '1998-08-31' GROUP BY period""")
def _(spark, sf):
    return rollups.dense_flow(rollups.daily_flow(postings(spark, sf)), "week", "1998-03-04", "1998-08-31").withColumn("period", F.col("period").cast("string"))


@query("role_demand", f"""WITH {WITH_COUNTRY}, e AS (SELECT category, c_mktsegment, unnest(list_distinct(list_append(countries, ''))) AS country, posted, created, closed FROM pc)
SELECT category, c_mktsegment, country AS countries, count(*) FILTER (WHERE {_open(NOW)}) AS open, count(*) FILTER (WHERE {_open(BEFORE)}) AS open_prev FROM e GROUP BY ALL HAVING open > 0 OR open_prev > 0""")
def _(spark, sf):
    return rollups.demand(with_country(spark, sf), ["category", "c_mktsegment"], "countries", _at(NOW), _at(BEFORE))


@query("role_country", f"""WITH {WITH_COUNTRY}, e AS (SELECT category, unnest(list_distinct(list_append(countries, ''))) AS country, posted, created, closed FROM pc WHERE {CANON})
SELECT category, country AS countries, count(*) FILTER (WHERE {_open(NOW)}) AS open, count(*) FILTER (WHERE {_open(BEFORE)}) AS open_prev FROM e GROUP BY ALL HAVING open > 0 OR open_prev > 0""")
def _(spark, sf):
    from gristmill.functions.predicates import canonical

    return rollups.demand(with_country(spark, sf).where(canonical()), ["category"], "countries", _at(NOW), _at(BEFORE))


@query("skill_demand", f"""WITH {WITH_COUNTRY}, {SKILLS}, e AS (SELECT unnest(skills) AS skill, category, n_name FROM pc JOIN sk USING (id) WHERE {_open(NOW)})
SELECT skill, '' AS category, '' AS n_name, count(*) AS n FROM e GROUP BY skill UNION ALL SELECT skill, category, '', count(*) FROM e GROUP BY skill, category UNION ALL SELECT skill, '', n_name, count(*) FROM e GROUP BY skill, n_name""")
def _(spark, sf):
    from gristmill.functions.predicates import open_at

    rows = with_country(spark, sf).where(open_at(_at(NOW))).join(skills(spark, sf), "id").select(F.explode("skills").alias("skill"), "category", "n_name")
    return rollups.grouped_cube(rows, [["skill"], ["skill", "category"], ["skill", "n_name"]], ["skill", "category", "n_name"], [F.count(F.lit(1)).alias("n")])


@query("role_skill_sample", f"""WITH {POSTINGS}, {SKILLS}, o AS (SELECT category, CASE WHEN id % 10 = 0 THEN [] ELSE skills END AS skills FROM p JOIN sk USING (id) WHERE {_open(NOW)}), s AS (SELECT category, count(*) AS sample FROM o WHERE len(skills) > 0 GROUP BY category)
SELECT category, skill, n, sample FROM (SELECT category, unnest(skills) AS skill, count(*) AS n FROM (SELECT category, skills FROM o) GROUP BY ALL) JOIN s USING (category)""".replace("unnest(skills) AS skill, count(*) AS n FROM (SELECT category, skills FROM o) GROUP BY ALL", "skill, count(*) AS n FROM (SELECT category, unnest(skills) AS skill FROM o) GROUP BY ALL"))
def _(spark, sf):
    from gristmill.functions.predicates import open_at

    rows = postings(spark, sf).where(open_at(_at(NOW))).join(skills(spark, sf), "id").withColumn("skills", F.when(F.col("id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.col("skills")))
    sample = rows.where(F.size("skills") > 0).groupBy("category").agg(F.count(F.lit(1)).alias("sample"))
    return rows.select("category", F.explode("skills").alias("skill")).groupBy("category", "skill").agg(F.count(F.lit(1)).alias("n")).join(sample, "category")


def _tiers(spark, sf):
    """Three tiers of salary columns from lineitem, each incomplete in some rows."""
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus",
        F.when(k % 4 == 0, q * 100).alias("min0"), F.when(k % 8 == 0, q * 100 + 51).alias("max0"), F.when(k % 12 != 0, F.lit(" usd ")).alias("cur0"), F.lit("year").alias("per0"),
        F.when(k % 3 == 0, -q).alias("min1"), F.when(k % 3 != 2, q * 90).alias("max1"), F.lit("eur").alias("cur1"), F.when(k % 5 != 0, F.lit("month")).alias("per1"),
        F.col("l_extendedprice").cast("int").alias("min2"), (F.col("l_extendedprice").cast("int") + 1).alias("max2"), F.col("l_returnflag").alias("cur2"), F.col("l_linestatus").alias("per2"),
    )


TIERS = """t AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) AS q, CAST(floor(l_extendedprice) AS INTEGER) AS e, l_orderkey AS k FROM lineitem),
u AS (SELECT *, CASE WHEN k % 4 = 0 THEN q * 100 END AS a0, CASE WHEN k % 8 = 0 THEN q * 100 + 51 END AS b0, CASE WHEN k % 12 <> 0 THEN 'USD' END AS c0, CASE WHEN k % 3 <> 2 THEN q * 90 END AS b1, CASE WHEN k % 5 <> 0 THEN 'month' END AS p1 FROM t),
s AS (SELECT *, CASE WHEN coalesce(a0, b0) IS NOT NULL AND c0 IS NOT NULL THEN 0 WHEN b1 IS NOT NULL AND p1 IS NOT NULL THEN 1 ELSE 2 END AS tier FROM u),
v AS (SELECT *, CASE tier WHEN 0 THEN CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN (a0 + b0) / 2.0 ELSE CAST(coalesce(a0, b0) AS DOUBLE) END WHEN 1 THEN CAST(b1 AS DOUBLE) ELSE (e + e + 1) / 2.0 END AS amount,
 CASE tier WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE upper(l_returnflag) END AS currency, CASE tier WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE l_linestatus END AS period FROM s)"""


def _salaries(spark, sf):
    pay = rollups.effective_salary([("min0", "max0", "cur0", "per0"), ("min1", "max1", "cur1", "per1"), ("min2", "max2", "cur2", "per2")])
    return _tiers(spark, sf).select("l_orderkey", "l_linenumber", "l_shipdate", pay.alias("s")).select("l_orderkey", "l_linenumber", "l_shipdate", F.col("s.amount").cast("double").alias("amount"), "s.currency", "s.period", "s.tier")


@query("salary_effective", f"WITH {TIERS} SELECT tier, currency, period, count(*) AS n, round(sum(amount), 2) AS total FROM v GROUP BY ALL")
def _(spark, sf):
    return _salaries(spark, sf).groupBy("tier", "currency", "period").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("salary_bands", f"""WITH {TIERS} SELECT currency, period, count(*) AS n, round(quantile_cont(amount, 0.25), 4) AS p25, round(quantile_cont(amount, 0.5), 4) AS p50, round(quantile_cont(amount, 0.75), 4) AS p75,
round(quantile_cont(amount, 0.05), 4) AS p5, round(quantile_cont(amount, 0.95), 4) AS p95 FROM v GROUP BY ALL HAVING count(*) >= 100""")
def _(spark, sf):
    out = rollups.salary_bands(_salaries(spark, sf), ["currency", "period"], "amount", 100)
    r = lambda c: F.round(c, 4)
    return out.select("currency", "period", "n", r(F.col("p25")).alias("p25"), r(F.col("p50")).alias("p50"), r(F.col("p75")).alias("p75"), r(F.col("quantiles")[0]).alias("p5"), r(F.col("quantiles")[18]).alias("p95"))


@query("salary_monthly", f"""WITH {TIERS} SELECT CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS month, currency, period, count(*) AS n, round(quantile_cont(amount, 0.5), 4) AS p50 FROM v GROUP BY ALL HAVING count(*) >= 20""")
def _(spark, sf):
    rows = _salaries(spark, sf).withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")).cast("string"))
    return rollups.salary_bands(rows, ["month", "currency", "period"], "amount", 20).select("month", "currency", "period", "n", F.round("p50", 4).alias("p50"))


@query("velocity", f"""WITH {POSTINGS}, e AS (SELECT CAST(created AS DATE) AS day, category, status, 1 AS a, 0 AS r FROM p UNION ALL SELECT CAST(closed AS DATE), category, status, 0, 1 FROM p WHERE closed IS NOT NULL),
k AS (SELECT day, 'all' AS kind, '' AS value, a, r FROM e UNION ALL SELECT day, 'category', category, a, r FROM e UNION ALL SELECT day, 'status', status, a, r FROM e)
SELECT CAST(day AS VARCHAR) AS day, kind, value, CAST(sum(a) AS BIGINT) AS added, CAST(sum(r) AS BIGINT) AS removed FROM k GROUP BY ALL""")
def _(spark, sf):
    return rollups.velocity(postings(spark, sf), ["category", "status"]).withColumn("day", F.col("day").cast("string"))


@query("role_pulse", f"""WITH {POSTINGS}, w AS (SELECT *, CAST(least(posted, created) AS DATE) AS x0, CAST(coalesce(closed, TIMESTAMP '{NOW}') AS DATE) AS x1 FROM p WHERE {CANON})
SELECT category, CAST(sum(greatest(0, date_diff('day', greatest(x0, DATE '{NOW}' - 30), least(x1, DATE '{NOW}')))) AS BIGINT) AS exposure, count(*) FILTER (WHERE {REAL} AND closed >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND closed < TIMESTAMP '{NOW}') AS closes,
median(CASE WHEN {REAL} AND closed >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND closed < TIMESTAMP '{NOW}' THEN CAST(date_diff('day', x0, CAST(closed AS DATE)) AS DOUBLE) END) AS median_close_days,
count(*) FILTER (WHERE least(posted, created) >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND least(posted, created) < TIMESTAMP '{NOW}') AS inflow FROM w GROUP BY category""")
def _(spark, sf):
    return rollups.pulse(postings(spark, sf), _at(NOW))


@query("company_daily", f"""WITH {POSTINGS}, e AS (SELECT company, CAST(least(posted, created) AS DATE) AS day, 1 AS a, 0 AS r FROM p WHERE {CANON} UNION ALL SELECT company, CAST(closed AS DATE), 0, 1 FROM p WHERE {CANON} AND closed IS NOT NULL),
f AS (SELECT company, day, sum(a) AS added, sum(r) AS removed FROM e GROUP BY ALL) SELECT company, CAST(day AS VARCHAR) AS day, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed, CAST(sum(added - removed) OVER (PARTITION BY company ORDER BY day) AS BIGINT) AS open FROM f""")
def _(spark, sf):
    return rollups.company_daily(postings(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("company_growth", f"""WITH {POSTINGS} SELECT company, count(*) FILTER (WHERE {_open(NOW)}) AS open, count(*) FILTER (WHERE {_open(BEFORE)}) AS open_prev, count(*) FILTER (WHERE {_open(NOW)}) - count(*) FILTER (WHERE {_open(BEFORE)}) AS growth FROM p WHERE {CANON} GROUP BY company HAVING open > 0 OR open_prev > 0""")
def _(spark, sf):
    return rollups.company_growth(postings(spark, sf), _at(NOW), _at(BEFORE))


@query("company_growth_ranked", f"""WITH {POSTINGS}, g AS (SELECT company, count(*) FILTER (WHERE {_open(NOW)}) AS open, count(*) FILTER (WHERE {_open(BEFORE)}) AS open_prev FROM p WHERE {CANON} GROUP BY company)
SELECT company, open, open_prev, open - open_prev AS growth FROM g WHERE greatest(open, open_prev) >= 5 ORDER BY growth DESC, company LIMIT 25""")
def _(spark, sf):
    return rollups.ranked_growth(rollups.company_growth(postings(spark, sf), _at(NOW), _at(BEFORE)), "growth", 5, 25)


@query("company_lifetime", f"""WITH {POSTINGS} SELECT company, count(*) AS n, CASE WHEN count(*) >= 3 THEN median(CAST(greatest(0, date_diff('day', CAST(least(posted, created) AS DATE), CAST(closed AS DATE))) AS DOUBLE)) END AS median_days
FROM p WHERE {CANON} AND {REAL} AND closed >= CAST(DATE '{NOW}' - 720 AS TIMESTAMP) AND closed <= TIMESTAMP '{NOW}' GROUP BY company""")
def _(spark, sf):
    return rollups.lifetime(postings(spark, sf), _at(NOW), 720, 3)


EV_NOW = "2024-01-30"


@query("company_views", f"""WITH d AS (SELECT user_id % 40 AS company, CAST(ts AS DATE) AS day, CAST(value AS BIGINT) AS uniques FROM events), s AS (SELECT company, sum(CASE WHEN date_diff('day', day, DATE '{EV_NOW}') BETWEEN 0 AND 9 THEN uniques END) AS recent, sum(CASE WHEN date_diff('day', day, DATE '{EV_NOW}') BETWEEN 10 AND 19 THEN uniques END) AS prior FROM d GROUP BY company)
SELECT company, CAST(coalesce(recent, 0) AS BIGINT) AS recent, CAST(coalesce(prior, 0) AS BIGINT) AS prior FROM s WHERE recent IS NOT NULL OR prior IS NOT NULL""".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def _(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 40).alias("company"), F.to_date("ts").alias("day"), F.floor("value").alias("uniques"))
    return rollups.windowed_sums(rows, "company", "uniques", "day", F.lit(EV_NOW).cast("date"), 10)


@query("company_response", """WITH a AS (SELECT o_custkey % 200 AS company, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 17 END AS days FROM orders)
SELECT company, count(*) AS n, count(days) AS answered, CASE WHEN count(*) >= 10 THEN round(count(days) / count(*), 6) END AS rate, CASE WHEN count(days) >= 5 THEN median(CAST(days AS DOUBLE)) END AS median_days FROM a GROUP BY company""")
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("company"), F.when(k % 3 == 0, k % 17).alias("days"))
    return rollups.response(rows, "company", "days").withColumn("rate", F.round("rate", 6))


@query("reply_benchmark", """WITH a AS (SELECT o_custkey % 300 AS who, o_orderstatus = 'F' AS ok FROM orders), o AS (SELECT who, count(*) AS n, count(*) FILTER (WHERE ok) AS n_answered FROM a GROUP BY who), t AS (SELECT CAST(sum(n) AS BIGINT) AS an, CAST(sum(n_answered) AS BIGINT) AS aa FROM o)
SELECT who, n, n_answered, an - n AS others, aa - n_answered AS others_answered, CASE WHEN n >= 10 AND an - n >= 10 THEN round(n_answered / n, 6) END AS rate, CASE WHEN n >= 10 AND an - n >= 10 THEN round((aa - n_answered) / (an - n), 6) END AS others_rate FROM o, t""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("who"), (F.col("o_orderstatus") == "F").alias("ok"))
    out = rollups.benchmark_rate(rows, "who", "ok")
    return out.withColumn("rate", F.round("rate", 6)).withColumn("others_rate", F.round("others_rate", 6))


@query("source_quality", """SELECT source, count(*) AS n, count(*) FILTER (WHERE lang IS NULL OR lang = '') AS no_lang, count(*) FILTER (WHERE trim(text) = '') AS no_body, count(*) FILTER (WHERE n_chars < 200) AS short, count(*) FILTER (WHERE doc_id % 30 > 23) AS unseen, min(doc_id) AS sample FROM documents GROUP BY source""")
def _(spark, sf):
    c = {"no_lang": F.col("lang").isNull() | (F.col("lang") == ""), "no_body": F.trim("text") == "", "short": F.col("n_chars") < 200, "unseen": F.col("doc_id") % 30 > 23}
    return rollups.quality_gaps(table(spark, sf, "documents"), c, "source", "doc_id")


WEEKLY = f"w AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, min_by(value, ts) AS value FROM events GROUP BY ALL), k AS (SELECT * FROM w WHERE week > CAST(date_trunc('week', DATE '{EV_NOW}') AS DATE) - 28)"


@query("skill_weekly", f"WITH {WEEKLY} SELECT event_type, CAST(week AS VARCHAR) AS week, value FROM k")
def _(spark, sf):
    return rollups.weekly_first(table(spark, sf, "events"), "event_type", "value", "ts", F.lit(EV_NOW), 4).withColumn("week", F.col("week").cast("string"))


@query("skill_trend", f"WITH {WEEKLY} SELECT event_type, max_by(value, week) AS latest, CASE WHEN count(*) > 1 THEN round((max_by(value, week) - min_by(value, week)) * 100.0 / min_by(value, week), 2) END AS change, array_to_string(list(value ORDER BY week), ',') AS series FROM k GROUP BY event_type")
def _(spark, sf):
    out = rollups.trend(rollups.weekly_first(table(spark, sf, "events"), "event_type", "value", "ts", F.lit(EV_NOW), 4), "event_type")
    return out.withColumn("series", F.array_join(F.transform("series", lambda v: v.cast("string")), ","))


@query("size_reconstructed", f"""WITH {POSTINGS}, {FLOW}, g AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-11-30', INTERVAL 1 DAY)) AS DATE) AS day),
f AS (SELECT g.day, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(added % 3, 0) AS pruned FROM g LEFT JOIN a ON a.day = g.day LEFT JOIN r ON r.day = g.day)
SELECT CAST(day AS VARCHAR) AS day, CAST(floor(sum(added - removed) OVER (ORDER BY day) + 0.5 * coalesce(sum(pruned) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) + 0.5) AS BIGINT) AS size FROM f""")
def _(spark, sf):
    flow = rollups.dense_flow(rollups.daily_flow(postings(spark, sf)), "day", "1995-01-01", "2001-11-30").withColumnRenamed("period", "day")
    return rollups.reconstructed_size(flow.withColumn("pruned", F.col("added") % 3)).withColumn("day", F.col("day").cast("string"))


@query("member_growth", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM d")
def _(spark, sf):
    return rollups.cumulative(table(spark, sf, "orders"), F.to_date("o_orderdate")).withColumn("day", F.col("day").cast("string"))


@query("filtered_having", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS cheap FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_returnflag = 'R') >= 190 OR count(*) FILTER (l_discount > 0.05) >= 280")
def _(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"))
    return out.where("returned >= 190 or cheap >= 280")


@query("tally", "SELECT lang, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1 AND toxic = 0) AS good, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic IS NULL) AS unjudged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("toxic").isNull()).alias("unjudged"))


@query("cohort_conversion", """WITH s AS (SELECT o_custkey AS who, min(o_orderdate) AS sent FROM orders GROUP BY 1), c AS (SELECT s.*, exists(SELECT 1 FROM orders o WHERE o.o_custkey = who AND o.o_orderdate > sent AND o.o_orderdate <= sent + INTERVAL 90 DAY AND o.o_orderstatus = 'F') AS paid FROM s)
SELECT CAST(CAST(date_trunc('month', sent) AS DATE) AS VARCHAR) AS month, count(*) AS sent_n, count(*) FILTER (WHERE sent + INTERVAL 90 DAY <= TIMESTAMP '1996-01-01') AS matured, count(*) FILTER (WHERE paid AND sent + INTERVAL 90 DAY <= TIMESTAMP '1996-01-01') AS paid_n FROM c GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("who"), "o_orderdate", "o_orderstatus")
    return joins.cohort(o, "who", "o_orderdate", F.col("o_orderstatus") == "F", 90, F.lit("1996-01-01").cast("timestamp"))


@query("raw_and_daily", """SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, 1 AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' UNION ALL SELECT event_type, count(*) FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY event_type, CAST(ts AS DATE)) GROUP BY event_type""")
def _(spark, sf):
    e = table(spark, sf, "events")
    daily = e.where("ts < timestamp'2024-01-20'").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).select("event_type", "n")
    return e.where("ts >= timestamp'2024-01-20'").select("event_type", F.lit(1).cast("long").alias("n")).unionAll(daily).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("distinct_arrays", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("ordered_string_agg", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS p FROM orders GROUP BY o_custkey")
def _(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ",").alias("p"))


@query("role_clusters", f"""WITH {POSTINGS}, c AS (SELECT *, CASE WHEN id % 9 = 0 THEN '' ELSE category || status END AS fp FROM p) SELECT company, fp, count(*) AS reposts, count(*) FILTER (WHERE closed IS NULL) AS mass FROM c WHERE fp <> '' GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    rows = postings(spark, sf).withColumn("fp", F.when(F.col("id") % 9 == 0, F.lit("")).otherwise(F.concat("category", "status")))
    return rollups.clusters(rows, "company", "fp")


@query("json_length_stats", "SELECT event_type, round(avg(n), 6) AS mean, median(n) AS mid, max(n) AS most FROM (SELECT event_type, json_array_length('[' || repeat('1,', CAST(event_id % 7 AS INTEGER)) || '1]') AS n FROM events) GROUP BY event_type".replace("max(n) AS most", "CAST(max(n) AS BIGINT) AS most"))
def _(spark, sf):
    body = F.concat(F.lit("["), F.repeat(F.lit("1,"), (F.col("event_id") % 7).cast("int")), F.lit("1]"))
    n = table(spark, sf, "events").select("event_type", F.json_array_length(body).alias("n"))
    return n.groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("mean"), F.median(F.col("n").cast("double")).alias("mid"), F.max("n").cast("long").alias("most"))


@query("asof_day", f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS first_id FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1) SELECT o.o_orderkey, CAST(d.day AS VARCHAR) AS day, d.first_id FROM orders o ASOF LEFT JOIN d ON o.o_orderkey >= d.first_id""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    marks = o.where("o_orderkey % 50 = 0").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("first_id"))
    return joins.asof(o.select("o_orderkey"), marks, "o_orderkey", "first_id", ["day"]).withColumn("day", F.col("day").cast("string"))


@query("drain_rate", """WITH s AS (SELECT user_id, ts, CAST(event_id % 97 AS BIGINT) AS depth FROM events), l AS (SELECT *, lag(depth) OVER (PARTITION BY user_id ORDER BY ts) - depth AS drop FROM s)
SELECT user_id, CAST(sum(greatest(0, coalesce(drop, 0))) AS BIGINT) AS drained, count(*) AS samples, CASE WHEN count(*) >= 2 AND epoch(max(ts)) - epoch(min(ts)) >= 300 THEN round(sum(greatest(0, coalesce(drop, 0))) / (epoch(max(ts)) - epoch(min(ts))) * 60, 6) END AS per_minute FROM l GROUP BY user_id""")
def _(spark, sf):
    s = table(spark, sf, "events").select("user_id", "ts", (F.col("event_id") % 97).alias("depth"))
    return joins.drain_rate(s, "user_id", "ts", "depth").withColumn("per_minute", F.round("per_minute", 6))


@query("keep_latest", "SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(spark, sf):
    return joins.latest(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), ["c_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("loser_to_canonical", "WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, first_value(o_orderkey) OVER w AS keep, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)) SELECT o_orderkey AS loser, keep FROM r WHERE rn > 1")
def _(spark, sf):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("loser"), F.first("o_orderkey").over(w).alias("keep"), F.row_number().over(w).alias("rn"))
    return r.where("rn > 1").select("loser", "keep")


@query("running_budget", "WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, sum(length(o_orderpriority) + 2) OVER w - 2 AS cost FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey FROM c WHERE cost <= 60")
def _(spark, sf):
    rows = table(spark, sf, "orders")
    return joins.within_budget(rows, ["o_custkey"], "o_orderkey", F.length("o_orderpriority"), 2, 60).select("o_custkey", "o_orderkey")


@query("capped_top", f"""WITH {POSTINGS}, f AS (SELECT * FROM p WHERE amount >= 100000 AND company NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)), r AS (SELECT id, company, amount, row_number() OVER (PARTITION BY company ORDER BY amount DESC, id) AS rn FROM f) SELECT id, company, amount FROM r WHERE rn <= 2 ORDER BY amount DESC, id LIMIT 60""")
def _(spark, sf):
    out = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("company"))
    return joins.capped_top(postings(spark, sf), "company", "amount", "id", floor=100000, cap=2, k=60, quarantined=out).select("id", "company", "amount")


@query("existence_flags", "SELECT c_custkey, exists(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 450000) OR exists(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice < 20000) AS seen FROM customer")
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey")
    a = o.where("o_orderstatus = 'F' and o_totalprice > 450000").select("o_custkey")
    b = o.where("o_orderpriority = '1-URGENT' and o_totalprice < 20000").select("o_custkey")
    return joins.flagged(c, {"a": (a, "o_custkey"), "b": (b, "o_custkey")}, "c_custkey").select("c_custkey", (F.col("a") | F.col("b")).alias("seen"))


@query("join_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 400000").select("o_custkey", "o_orderkey")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("scalar_max_join", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS latest, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def _(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    out = table(spark, sf, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "latest", F.coalesce("pending", F.lit(0)).cast("long").alias("pending"))


@query("gated_anti_join", """WITH b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_suppkey FROM b WHERE l_suppkey % 3 = 0)
SELECT DISTINCT l_suppkey, l_partkey FROM lineitem a WHERE l_returnflag = 'N' AND l_suppkey IN (SELECT l_suppkey FROM c) AND NOT EXISTS (SELECT 1 FROM b WHERE b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    board = li.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    return joins.gated_anti(li.where("l_returnflag = 'N'").select("l_suppkey", "l_partkey").distinct(), board, "l_suppkey", ["l_suppkey", "l_partkey"], gate=F.col("l_suppkey") % 3 == 0)


@query("unique_claim", """WITH n AS (SELECT DISTINCT lower(p_name) AS name, p_brand AS domain FROM part) SELECT name, min(domain) AS domain FROM n GROUP BY name HAVING count(DISTINCT domain) = 1""")
def _(spark, sf):
    return joins.unique_claims(table(spark, sf, "part").select(F.lower("p_name").alias("name"), F.col("p_brand").alias("domain")), "name", "domain")


@query("tiered_resolution", """WITH m AS (SELECT event_id, user_id, event_type FROM events), t AS (SELECT o_orderkey, o_custkey FROM orders), n AS (SELECT o_custkey, count(*) AS k, min(o_orderkey) AS only FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY 1)
SELECT event_id, coalesce(t.o_orderkey, CASE WHEN n.k = 1 THEN n.only END) AS target, CASE WHEN t.o_orderkey IS NOT NULL THEN 'thread' WHEN n.k = 1 THEN 'name' WHEN n.k > 1 THEN 'ambiguous' ELSE 'none' END AS how
FROM m LEFT JOIN t ON t.o_orderkey = m.event_id * 4 LEFT JOIN n ON n.o_custkey = m.user_id""")
def _(spark, sf):
    m = table(spark, sf, "events").select("event_id", (F.col("event_id") * 4).alias("thread"), F.col("user_id").alias("name"))
    o = table(spark, sf, "orders")
    threads = o.select(F.col("o_orderkey").alias("thread"), F.col("o_orderkey").alias("target"))
    names = o.where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("target"))
    return joins.resolve(m, threads, names, "thread", "name").select("event_id", "target", "how")


@query("report_diff", """WITH b AS (SELECT p_brand, avg(p_retailprice) AS v FROM part WHERE p_size <= 25 GROUP BY 1), t AS (SELECT p_brand, avg(p_retailprice) AS v FROM part WHERE p_size > 25 GROUP BY 1)
SELECT p_brand, round(t.v - b.v, 4) AS delta, round(t.v - b.v, 4) = (SELECT round(min(t2.v - b2.v), 4) FROM b b2 JOIN t t2 USING (p_brand)) AS worst FROM b JOIN t USING (p_brand)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    avg = lambda c: p.where(c).groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    return joins.report_diff(avg("p_size <= 25"), avg("p_size > 25"), "p_brand", "v")


@query("closure_union", f"""WITH RECURSIVE {WITH_COUNTRY}, e AS (SELECT id, CASE WHEN id % 4 <> 0 THEN id - 1 END AS parent, n_name, closed FROM pc), c AS (SELECT id, id AS node, 0 AS depth FROM e UNION ALL SELECT c.id, e.parent, depth + 1 FROM c JOIN e ON e.id = c.node WHERE e.parent IS NOT NULL AND depth < 8),
r AS (SELECT id, arg_max(node, depth) AS root FROM c GROUP BY id) SELECT root, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS geo, count(*) AS n FROM r JOIN e USING (id) WHERE closed IS NULL GROUP BY root""")
def _(spark, sf):
    rows = with_country(spark, sf).select("id", F.when(F.col("id") % 4 != 0, F.col("id") - 1).alias("parent"), "n_name", "closed")
    roots = joins.climb(rows, "id", "parent", depth=8)
    return roots.join(rows.where("closed is null").select("id", "n_name"), "id").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("geo"), F.count(F.lit(1)).alias("n"))


@query("diff_publish", f"""WITH old AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_custkey % 10 <> 1 GROUP BY 1), new AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-03-01' AND o_custkey % 10 <> 2 GROUP BY 1)
SELECT CASE WHEN old.k IS NULL THEN 'insert' WHEN new.k IS NULL THEN 'delete' WHEN old.v IS DISTINCT FROM new.v THEN 'update' ELSE 'same' END AS action, count(*) AS n FROM old FULL JOIN new ON old.k = new.k GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    per = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    diff = joins.diff(per("o_orderdate < timestamp'1999-01-01' and o_custkey % 10 <> 1"), per("o_orderdate < timestamp'1999-03-01' and o_custkey % 10 <> 2"), ["k"])
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_variants", """WITH o AS (SELECT user_id AS k, count(*) AS v, max(ts) AS at FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id AS k, count(*) AS v, max(ts) AS at FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.v, n.v) AS keep, coalesce(n.v, o.v) AS overwrite, coalesce(o.v, 0) + coalesce(n.v, 0) AS additive, greatest(o.v, n.v) AS monotone, CASE WHEN o.k IS NULL THEN n.v WHEN n.at > o.at THEN n.v ELSE o.v END AS guarded FROM o FULL JOIN n ON o.k = n.k""")
def _(spark, sf):
    e = table(spark, sf, "events")
    per = lambda c: e.where(c).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("v"), F.max("ts").alias("at"))
    old, new = per("event_id % 2 = 0"), per("event_id % 2 = 1 and user_id % 3 <> 0")
    how = {"keep": "keep", "overwrite": "overwrite", "additive": "add", "monotone": "max", "guarded": "newer"}
    return joins.upsert(old, new, "k", "v", how, at="at")


@query("move_and_rollup", """SELECT 'daily' AS part, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL UNION ALL SELECT 'raw', CAST(CAST(ts AS DATE) AS VARCHAR), event_type, count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL""")
def _(spark, sf):
    e = table(spark, sf, "events")
    kept, daily = joins.retire(e, "ts", F.lit("2024-01-15").cast("timestamp"), ["event_type"])
    raw = kept.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("raw"))
    return daily.withColumn("part", F.lit("daily")).unionByName(raw).withColumn("day", F.col("day").cast("string"))


@query("coverage_verdict", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), c AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = s.l_orderkey AND o_orderstatus = 'F') THEN 'by id' WHEN EXISTS (SELECT 1 FROM c WHERE c.l_partkey = s.l_partkey AND c.l_suppkey = s.l_suppkey) THEN 'by role' WHEN EXISTS (SELECT 1 FROM c WHERE c.l_suppkey = s.l_suppkey AND s.l_suppkey % 2 = 0) THEN 'company known' ELSE 'unknown' END AS verdict, count(*) AS n FROM s GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.select("l_orderkey", "l_partkey", "l_suppkey")
    c = li.where("l_orderkey % 2 = 1").select("l_partkey", "l_suppkey")
    f = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    flags = joins.flagged(s, {"id": (f, "l_orderkey"), "role": (c, ["l_partkey", "l_suppkey"]), "known": (c.where("l_suppkey % 2 = 0").select("l_suppkey"), "l_suppkey")}, None)
    verdict = F.when(F.col("id"), "by id").when(F.col("role"), "by role").when(F.col("known"), "company known").otherwise("unknown")
    return flags.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
