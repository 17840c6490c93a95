"""Joins with a rule: as-of, existence flags, gated anti, tiers, closure, diff, upsert; and windows with a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on_left: str, on_right: str, take: list[str], by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """left with on_right and the columns take of the last row of right whose on_right is not after on_left; null where there is none.

    One union and a running last value, no pairs.  Without by the running value
    would need one partition: the rows are cut into ranges of the key, and each
    range starts from the last right row before it (one row a range).  There are
    `slices` ranges, or 64 and one more for each million right rows.  Of right rows
    that share the key the largest counts, compared by the columns take in order.
    """
    rkeys = F.struct(F.col(on_right), *take)
    marks = right.where(F.col(on_right).isNotNull()).groupBy(*(by or []), on_right).agg(F.max(F.struct(*take)).alias("_t")).select(*(by or []), on_right, *(F.col("_t").getField(c).alias(c) for c in take))
    l_cols = left.columns
    a = left.withColumn("_k", F.col(on_left)).withColumn("_r", F.lit(None).cast(marks.select(rkeys.alias("r")).schema["r"].dataType)).withColumn("_side", F.lit(1))
    b = marks.select(*(by or []), F.col(on_right).alias("_k"), rkeys.alias("_r"), F.lit(0).alias("_side"))
    rows = a.unionByName(b, allowMissingColumns=True)
    order = ["_k", "_side"]
    if by:
        filled = rows.withColumn("_last", F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        # Cut points from the (distinct) right keys, by quantiles: at most `slices` numbers.
        slices = slices or min(4096, 64 + right.count() // 1_000_000)
        points = marks.select(F.percentile_approx(F.col(on_right), F.array(*(F.lit(i / slices) for i in range(1, slices))), F.lit(1000)).alias("p")).first()["p"] or []
        cuts = sorted(set(points))
        piece = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("_k") >= c)) if cuts else F.lit(0)
        rows = rows.withColumn("_piece", piece)
        ends = b.withColumn("_piece", piece).groupBy("_piece").agg(F.max("_r").alias("_end"))
        carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)))  # a row a piece
        last = F.last("_r", ignorenulls=True).over(Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        filled = rows.withColumn("_last", last).join(F.broadcast(carry.select("_piece", "_carry")), "_piece", "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return filled.where("_side = 1").select(*l_cols, F.col("_last").getField(on_right).alias(on_right), *(F.col("_last").getField(c).alias(c) for c in take))


def cohort(df: DataFrame, who: str, at: str, success: Column, days: int, now: Column) -> DataFrame:
    """month of the first event, sent_n, matured (window over by now), paid_n (matured, with a later success inside the window)."""
    first = F.min(at).over(Window.partitionBy(who))
    rows = df.withColumn("_sent", first)
    within = (F.col(at) > F.col("_sent")) & (F.col(at) <= F.timestamp_add("DAY", F.lit(days), F.col("_sent"))) & success
    per = rows.groupBy(who).agg(F.first("_sent").alias("sent"), F.max(F.coalesce(within, F.lit(False))).alias("paid"))
    ripe = F.timestamp_add("DAY", F.lit(days), F.col("sent")) <= now
    return per.groupBy(F.to_date(F.date_trunc("month", "sent")).cast("string").alias("month")).agg(F.count(F.lit(1)).alias("sent_n"), F.count_if(ripe).alias("matured"), F.count_if(ripe & F.col("paid")).alias("paid_n"))


def drain_rate(df: DataFrame, key: str, at: str, depth: str, min_span: int = 300) -> DataFrame:
    """key, drained (sum of falls), samples, per_minute (null for one sample or a short span)."""
    fall = F.greatest(F.lit(0), F.coalesce(F.lag(depth).over(Window.partitionBy(key).orderBy(at)) - F.col(depth), F.lit(0)))
    per = df.withColumn("_fall", fall).groupBy(key).agg(F.sum("_fall").alias("drained"), F.count(F.lit(1)).alias("samples"), (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("_us"))
    rate = F.when((F.col("samples") >= 2) & (F.col("_us") >= min_span * 1_000_000), F.col("drained") / (F.col("_us") / 1e6) * 60)
    return per.select(key, "drained", "samples", rate.alias("per_minute"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def within_budget(df: DataFrame, keys: list[str], order: str, cost: Column, separator: int, budget: int) -> DataFrame:
    """The longest prefix of each key's rows whose costs, with a separator between rows, stay within the budget."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_cost", F.sum(cost + separator).over(w) - separator).where(F.col("_cost") <= budget).drop("_cost")


def capped_top(df: DataFrame, group: str, score: str, tie: str, floor: float, cap: int, k: int, quarantined: DataFrame | None = None) -> DataFrame:
    """The k best rows from the floor up, at most cap a group, quarantined groups left out."""
    rows = df.where(F.col(score) >= floor)
    if quarantined is not None:
        rows = rows.join(quarantined, group, "left_anti")
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn").orderBy(F.desc(score), tie).limit(k)


def flagged(df: DataFrame, flags: dict[str, tuple[DataFrame, str | list[str]]], key: str | None) -> DataFrame:
    """df with a boolean for each flag: whether a row with the keys is in the other frame.  key: df's column, if named otherwise."""
    for name, (other, on) in flags.items():
        on = [on] if isinstance(on, str) else on
        there = other.select(*on).distinct().withColumn(name, F.lit(True))
        if key is not None:
            there = there.withColumnRenamed(on[0], key)
            on = [key]
        df = df.join(there, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def gated_anti(df: DataFrame, known: DataFrame, company: str, keys: list[str], gate: Column | None = None) -> DataFrame:
    """Rows whose keys are not known, only of companies that have a known row at all (and pass the gate)."""
    companies = known.select(company).distinct()
    if gate is not None:
        companies = companies.where(gate)
    return df.join(companies, company, "left_semi").join(known, keys, "left_anti")


def unique_claims(df: DataFrame, name: str, claim: str) -> DataFrame:
    """name, claim of names that one claim alone holds."""
    return df.groupBy(name).agg(F.min(claim).alias("_a"), F.max(claim).alias("_b")).where("_a = _b").select(name, F.col("_a").alias(claim))


def resolve(df: DataFrame, threads: DataFrame, names: DataFrame, thread: str, name: str) -> DataFrame:
    """df with target and how: by thread, else by the only target of the name, else ambiguous or none."""
    by_name = names.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.min("target").alias("_only"))
    out = df.join(threads.withColumnRenamed("target", "_thread"), thread, "left").join(by_name, name, "left")
    target = F.coalesce("_thread", F.when(F.col("_n") == 1, F.col("_only")))
    how = F.when(F.col("_thread").isNotNull(), "thread").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return out.withColumn("target", target).withColumn("how", how).drop("_thread", "_n", "_only")


def report_diff(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """key, delta, worst: what the other report changes, and where it drops most."""
    d = base.select(key, F.col(value).alias("_b")).join(other.select(key, F.col(value).alias("_t")), key).select(key, F.round(F.col("_t") - F.col("_b"), 4).alias("delta"))
    return d.select(key, "delta", (F.col("delta") == d.agg(F.min("delta")).scalar()).alias("worst"))


def climb(df: DataFrame, key: str, parent: str, depth: int = 8) -> DataFrame:
    """key, root: the ancestor reached by following parents, at most depth steps.

    Pointers are doubled, so three joins climb eight steps; rows whose parent is
    missing from the frame stop there.
    """
    steps = []
    hop = df.select(F.col(key).alias("id"), F.col(parent).alias("up")).where("up is not null").join(df.select(F.col(key).alias("up")), "up", "left_semi").select("id", "up")
    at, left = df.select(F.col(key).alias("id"), F.col(key).alias("root")), depth
    while left:
        steps.append(left & 1)
        if left & 1:
            at = at.join(hop.select(F.col("id").alias("root"), F.col("up").alias("_up")), "root", "left")
            at = at.select("id", F.coalesce("_up", "root").alias("root"))
        left >>= 1
        if left:
            nxt = hop.select(F.col("id").alias("up"), F.col("up").alias("_up"))
            hop = hop.join(nxt, "up", "left").select("id", F.coalesce("_up", "up").alias("up"))
    return at.select(F.col("id").alias(key), "root")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the new values and action: insert, delete, update or same, by null-safe comparison of all other columns."""
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("_old"))
    n = new.select(*keys, F.struct(*values).alias("_new"))
    both = o.join(n, keys, "full")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("same")
    return both.select(*keys, *(F.col("_new").getField(v).alias(v) for v in values), action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, how: dict[str, str], at: str | None = None) -> DataFrame:
    """key and a column for each rule: keep the old, overwrite, add, max, or the newer by column at; one row a key on either side."""
    cols = [value, *([at] if at else [])]
    o = old.select(key, F.struct(*cols).alias("o"))
    n = new.select(key, F.struct(*cols).alias("n"))
    both = o.join(n, key, "full")
    a, b = F.col("o").getField(value), F.col("n").getField(value)
    rules = {"keep": F.coalesce(a, b), "overwrite": F.coalesce(b, a), "add": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest(a, b)}
    if at:
        rules["newer"] = F.when(F.col("o").isNull() | (F.col("n").getField(at) > F.col("o").getField(at)), b).otherwise(a)
    return both.select(key, *(rules[r].alias(name) for name, r in how.items()))


def retire(df: DataFrame, at: str, before: Column, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and the daily counts of those to move out."""
    old = df.where(F.col(at) < before).groupBy(F.to_date(at).alias("day"), *dims).agg(F.count(F.lit(1)).alias("n"))
    return df.where(F.col(at) >= before), old
