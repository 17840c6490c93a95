"""Market rollups over postings.

Frames have the columns id, company, category, posted, created, closed, reason,
duplicate_of and is_private unless a parameter says otherwise.  "" in a
dimension is the bucket of all; real empty keys are left out first.  Days are
UTC days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.predicates import canonical, exists_from, open_at, really_closed


def daily_flow(df: DataFrame) -> DataFrame:
    """day, added, removed: two partial counts meet in one shuffle."""
    events = F.array(F.struct(F.to_date("created").alias("day"), F.lit(1).alias("a"), F.lit(0).alias("r")), F.struct(F.to_date("closed").alias("day"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    return df.select(F.explode(events).alias("e")).where("e.day is not null").groupBy("e.day").agg(F.sum("e.a").alias("added"), F.sum("e.r").alias("removed"))


def dense_flow(flow: DataFrame, granularity: str, start: str, end: str) -> DataFrame:
    """period, added, removed for every day, week or month of [start, end], zeros where nothing happened."""
    if granularity not in ("day", "week", "month"):
        raise ValueError(f"granularity must be day, week or month, not {granularity!r}")
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[granularity]
    cut = lambda c: F.to_date(F.date_trunc(granularity, c))
    calendar = flow.sparkSession.range(1).select(F.explode(F.expr(f"sequence(to_date(date_trunc('{granularity}', date'{start}')), date'{end}', {step})")).alias("period"))
    grouped = flow.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy(cut("day").alias("period")).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return calendar.join(grouped, "period", "left").select("period", F.coalesce("added", F.lit(0)).cast("long").alias("added"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))


def _open_counts(now: Column, before: Column) -> list[Column]:
    return [F.count_if(open_at(now)).alias("open"), F.count_if(open_at(before)).alias("open_prev")]


def demand(df: DataFrame, dims: list[str], multi: str | None, now: Column, before: Column) -> DataFrame:
    """dims, multi ("" = all), open, open_prev.

    A posting with several values of the array column multi counts once in the
    bucket of all, and once for each value; rows that are 0 on both days are left out.
    """
    keyed = df.where(" and ".join(f"{d} is not null and {d} <> ''" for d in dims)) if dims else df
    if multi is None:
        out = keyed.groupBy(*dims).agg(*_open_counts(now, before))
    else:
        buckets = F.explode(F.array_union(F.array(F.lit("")), F.filter(F.array_distinct(F.coalesce(multi, F.array().cast("array<string>"))), lambda v: v.isNotNull() & (v != ""))))
        out = keyed.withColumn("_m", buckets).groupBy(*dims, F.col("_m").alias(multi)).agg(*_open_counts(now, before))
    return out.where("open > 0 or open_prev > 0")


def grouped_cube(df: DataFrame, sets: list[list[str]], dims: list[str], aggs: list[Column]) -> DataFrame:
    """Grouping sets with "" in the dimensions that a set leaves out."""
    clean = df.where(" and ".join(f"({d} is null or {d} <> '')" for d in dims))
    out = clean.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(*aggs, F.grouping_id().alias("_gid"))
    n = len(dims)
    for i, d in enumerate(dims):
        absent = F.col("_gid").bitwiseAND(1 << (n - 1 - i)) != 0
        out = out.withColumn(d, F.when(absent, F.lit("")).otherwise(F.col(d)))
    return out.where(" and ".join(f"{d} is not null" for d in dims)).drop("_gid")


def company_daily(df: DataFrame, key: str = "company") -> DataFrame:
    """key, day, added, removed, open: only days with activity, open as running sum of canonical rows."""
    rows = df.where(canonical() & F.col(key).isNotNull())
    events = F.array(F.struct(F.to_date(exists_from()).alias("day"), F.lit(1).alias("a"), F.lit(0).alias("r")), F.struct(F.to_date("closed").alias("day"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    flow = rows.select(key, F.explode(events).alias("e")).where("e.day is not null").groupBy(key, "e.day").agg(F.sum("e.a").alias("added"), F.sum("e.r").alias("removed"))
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return flow.withColumn("open", F.sum(F.col("added") - F.col("removed")).over(w))


def company_growth(df: DataFrame, now: Column, before: Column, key: str = "company") -> DataFrame:
    """key, open, open_prev, growth of canonical rows."""
    out = df.where(canonical() & F.col(key).isNotNull()).groupBy(key).agg(*_open_counts(now, before))
    return out.where("open > 0 or open_prev > 0").withColumn("growth", F.col("open") - F.col("open_prev"))


def ranked_growth(growth: DataFrame, order: str, min_open: int, k: int, key: str = "company") -> DataFrame:
    """The k first by growth, -growth or open, among those with min_open open on either day."""
    by = {"growth": F.desc("growth"), "-growth": F.asc("growth"), "open": F.desc("open")}[order]
    return growth.where(F.greatest("open", "open_prev") >= min_open).orderBy(by, key).limit(k)


def velocity(df: DataFrame, facets: list[str]) -> DataFrame:
    """day, kind, value, added, removed; kind all has value ""."""
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")), *(F.struct(F.lit(f).alias("kind"), F.col(f).cast("string").alias("value")) for f in facets))
    events = F.array(F.struct(F.to_date("created").alias("day"), F.lit(1).alias("a"), F.lit(0).alias("r")), F.struct(F.to_date("closed").alias("day"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    rows = df.withColumn("k", F.explode(kinds)).withColumn("e", F.explode(events)).where("e.day is not null and k.value is not null")
    return rows.groupBy("e.day", "k.kind", "k.value").agg(F.sum("e.a").alias("added"), F.sum("e.r").alias("removed"))


def effective_salary(tiers: list[tuple[str, str, str, str]]) -> Column:
    """Struct (amount, currency, period, tier) of the first complete tier, null if none.

    Tiers are (min, max, currency, period) column names.  Complete: a positive
    bound, a currency and a period.  The amount is the midpoint in decimals, or
    the bound that there is.
    """
    out = F.lit(None).cast("struct<amount:decimal(38,6),currency:string,period:string,tier:int>")
    for i, (lo, hi, cur, per) in reversed(list(enumerate(tiers))):
        a, b = (F.when(F.col(c) > 0, F.col(c).cast("decimal(28,6)")) for c in (lo, hi))
        currency, period = F.nullif(F.upper(F.trim(cur)), F.lit("")), F.nullif(F.trim(per), F.lit(""))
        amount = F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)).cast("decimal(38,6)")
        made = F.struct(amount.alias("amount"), currency.alias("currency"), period.alias("period"), F.lit(i).alias("tier"))
        out = F.when(amount.isNotNull() & currency.isNotNull() & period.isNotNull(), made).otherwise(out)
    return out


def quantiles(df: DataFrame, dims: list[str], amount: str, steps: list[float]) -> DataFrame:
    """dims, n, quantiles: exact, between neighbouring values in proportion; null amounts take no part.

    Equal amounts are one row with a count, and the places come from running
    sums of counts, so that no group's values have to fit in one buffer.
    """
    rows = df.where(F.col(amount).isNotNull()).groupBy(*dims, F.col(amount).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*dims).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("_c").over(run)).withColumn("n", F.sum("_c").over(Window.partitionBy(*dims)))
    held = lambda place: (F.col("_end") > place) & (F.col("_end") - F.col("_c") <= place)
    at = [(F.col("n") - 1) * x for x in steps]
    low = [F.max(F.when(held(F.floor(p)), F.col("_v"))).alias(f"_l{i}") for i, p in enumerate(at)]
    high = [F.max(F.when(held(F.ceil(p)), F.col("_v"))).alias(f"_h{i}") for i, p in enumerate(at)]
    out = rows.groupBy(*dims, "n").agg(*low, *high)
    between = lambda i, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_l{i}")).otherwise((F.ceil(p) - p) * F.col(f"_l{i}") + (p - F.floor(p)) * F.col(f"_h{i}"))
    return out.select(*dims, "n", F.array(*(between(i, p) for i, p in enumerate(at))).alias("quantiles"))


def salary_bands(df: DataFrame, dims: list[str], amount: str, min_sample: int = 5) -> DataFrame:
    """dims, n, p25, p50, p75, quantiles (5 % to 95 % by 5): exact; groups below min_sample are left out."""
    out = quantiles(df, dims, amount, [i / 100 for i in range(5, 100, 5)]).where(F.col("n") >= min_sample)
    return out.select(*dims, "n", *(F.col("quantiles")[i].alias(f"p{p}") for i, p in ((4, 25), (9, 50), (14, 75))), "quantiles")


def lifetime(df: DataFrame, now: Column, days: int = 180, min_n: int = 5, key: str = "company") -> DataFrame:
    """key, n, median_days over real closures of the last days; the median is null below min_n."""
    age = F.greatest(F.date_diff("closed", exists_from()), F.lit(0))
    rows = df.where(canonical() & really_closed() & F.col("closed").between(F.date_sub(now, days).cast("timestamp"), now))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median(age.cast("double")).alias("median_days")).withColumn("median_days", F.when(F.col("n") >= min_n, F.col("median_days")))


def exposure_days(start: Column, end: Column, w0: Column, w1: Column) -> Column:
    """Days of [start, end) inside [w0, w1)."""
    return F.greatest(F.lit(0), F.date_diff(F.least(F.coalesce(end, w1), w1), F.greatest(start, w0)))


def pulse(df: DataFrame, now: Column, days: int = 30, key: str = "category") -> DataFrame:
    """key, exposure days in the window, closes, median_close_days (null if none), inflow."""
    w0 = F.date_sub(now, days).cast("timestamp")
    inside = lambda c: (c >= w0) & (c < now)
    closes = really_closed() & inside(F.col("closed"))
    age = F.when(closes, F.date_diff("closed", exists_from()).cast("double"))
    return df.where(canonical()).groupBy(key).agg(
        F.sum(exposure_days(exists_from(), F.col("closed"), w0, now)).cast("long").alias("exposure"), F.count_if(closes).alias("closes"), F.median(age).alias("median_close_days"), F.count_if(inside(exists_from())).alias("inflow")
    )


def windowed_sums(df: DataFrame, key: str, value: str, at: str, now: Column, days: int = 30) -> DataFrame:
    """key, recent, prior: sums over the last days and the days before those; keys with neither are left out."""
    age = F.date_diff(now, at)
    out = df.groupBy(key).agg(F.sum(F.when(age.between(0, days - 1), F.col(value))).alias("recent"), F.sum(F.when(age.between(days, 2 * days - 1), F.col(value))).alias("prior"))
    return out.where("recent is not null or prior is not null").fillna(0, ["recent", "prior"])


def response(df: DataFrame, key: str, answered_after: str, min_n: int = 10, min_answered: int = 5) -> DataFrame:
    """key, n, answered, rate and median_days: gated by their numbers (null below)."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(answered_after).alias("answered"), F.median(F.col(answered_after).cast("double")).alias("m"))
    return out.select(key, "n", "answered", F.when(F.col("n") >= min_n, F.col("answered") / F.col("n")).alias("rate"), F.when(F.col("answered") >= min_answered, F.col("m")).alias("median_days"))


def benchmark_rate(df: DataFrame, who: str, answered: str, min_n: int = 10) -> DataFrame:
    """who, n, n_answered, others, others_answered, both rates (null below min_n): each against everyone else."""
    own = df.groupBy(who).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(answered)).alias("n_answered"))
    all_n, all_answered = own.agg(F.sum("n")).scalar(), own.agg(F.sum("n_answered")).scalar()
    rest = own.select(who, "n", "n_answered", F.greatest(F.lit(0), all_n - F.col("n")).alias("others"), F.greatest(F.lit(0), all_answered - F.col("n_answered")).alias("others_answered"))
    rate = lambda a, b: F.when((F.col("n") >= min_n) & (F.col("others") >= min_n), F.col(a) / F.col(b))
    return rest.withColumn("rate", rate("n_answered", "n")).withColumn("others_rate", rate("others_answered", "others"))


def quality_gaps(df: DataFrame, checks: dict[str, Column], key: str, sample: str) -> DataFrame:
    """key, n, one count a check, least sample value: one grouped scan."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()), F.min(sample).alias("sample"))


def weekly_first(df: DataFrame, key: str, value: str, at: str, now: Column, weeks: int = 26) -> DataFrame:
    """key, week, value: the first value of each ISO week, weeks older than the retention left out."""
    week = F.to_date(F.date_trunc("week", at))
    rows = df.groupBy(key, week.alias("week")).agg(F.min_by(value, at).alias("value"))
    return rows.where(F.col("week") > F.date_sub(F.to_date(F.date_trunc("week", now)), 7 * weeks))


def trend(weekly: DataFrame, key: str) -> DataFrame:
    """key, latest, change in percent since the first week (null for one point), series in order."""
    out = weekly.groupBy(key).agg(F.max_by("value", "week").alias("latest"), F.min_by("value", "week").alias("first"), F.count(F.lit(1)).alias("points"), F.array_sort(F.collect_list(F.struct("week", "value"))).alias("s"))
    change = F.when((F.col("points") > 1) & (F.col("first") != 0), F.round((F.col("latest") - F.col("first")) * 100.0 / F.col("first"), 2))
    return out.select(key, "latest", change.alias("change"), F.transform("s", lambda x: x["value"]).alias("series"))


def reconstructed_size(flow: DataFrame, share: float = 0.5) -> DataFrame:
    """day, size: running sum of added - removed, plus share of the rows pruned later that existed by the day; half up.  flow: day, added, removed, pruned."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return flow.select("day", F.floor(F.sum(F.col("added") - F.col("removed")).over(w) + share * F.coalesce(F.sum("pruned").over(back), F.lit(0)) + 0.5).cast("long").alias("size"))


def cumulative(df: DataFrame, day: Column) -> DataFrame:
    """day, n, total: members by day, and so far."""
    per = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def clusters(df: DataFrame, company: str, fingerprint: str, closed: str = "closed") -> DataFrame:
    """company, fingerprint, reposts (any state), mass (open); empty fingerprints never cluster, single rows are left out."""
    rows = df.where((F.col(fingerprint) != "") & F.col(company).isNotNull())
    return rows.groupBy(company, fingerprint).agg(F.count(F.lit(1)).alias("reposts"), F.count_if(F.col(closed).isNull()).alias("mass")).where("reposts > 1")
