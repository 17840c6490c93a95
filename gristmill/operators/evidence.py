"""Classifications from evidence: liveness, reality, silence, ghost levels, unseen vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import plain_text
from gristmill.functions.times import whole_days

#: Days of silence allowed at each stage.
SILENCE = {"applied": 21, "screening": 18, "interview": 15, "test": 12, "offer": 5}


#: What a page says when its posting is closed, what a list of postings says, and the mark of an error in an address.
CLOSED = (
    r"job (is )?no longer available", r"job.*no longer open", r"position has been filled", r"this job has expired", r"job posting has expired", r"no longer accepting applications",
    r"this (position|role|job) (is )?no longer", r"this job (listing )?is closed", r"this job post is closed", r"the job ad is no longer active", r"job (listing )?not found",
    r"the page you are looking for doesn.t exist", r"applications?\s+(?:(?:have|are|is)\s+)?closed", r"diese stelle (ist )?(nicht mehr|bereits) besetzt", r"offre (expirée|n'est plus disponible)",
    r"ваканси\S* (в архиве|закрыта|неактивна)",
)
LISTING = (r"\d+\s+jobs?\s+found", r"search for jobs page is loaded")
ERROR_URL = r"[?&]error=true"


def liveness(status: Column, url: Column, body: Column, least: int = 300) -> Column:
    """Struct (verdict, reason) of an answer: expired, uncertain or live; only expired ones have a reason.

    404 and 410 are gone; other failures (null too) are uncertain.  Of successful
    answers the address of an error, a closed posting's words, a list of postings
    and fewer than `least` characters of visible text count, in this order.
    """
    text = F.coalesce(body, F.lit(""))
    says = lambda c, *patterns: F.coalesce(c, F.lit("")).rlike("(?iu)" + "|".join(patterns))
    reason = (
        F.when(status.isin(404, 410), "http_gone").when(~F.coalesce(status.between(200, 299), F.lit(False)), "").when(says(url, ERROR_URL), "expired_url").when(says(text, *CLOSED), "expired_body")
        .when(says(text, *LISTING), "listing_page").when(F.length(plain_text(text)) < least, "insufficient_content")
    )
    return F.struct(F.when(reason == "", "uncertain").when(reason.isNull(), "live").otherwise("expired").alias("verdict"), F.nullif(reason, F.lit("")).alias("reason"))


def reality(created: Column, posted: Column, reposts: Column, mass: Column, evergreen_text: Column, now: Column) -> Column:
    """Struct (class, fake_fresh): evergreen on two signals, fresh within 14 days without evergreen text, else stale.

    Signals: 90 days old, three reposts beyond the mass, a mass of five, evergreen
    text.  Fake freshness: posted within 14 days but first seen over 90 days ago.
    """
    age, said = whole_days(now, created), whole_days(now, F.coalesce(posted, created))
    signals = (age >= 90).cast("int") + ((reposts - mass) >= 3).cast("int") + (mass >= 5).cast("int") + evergreen_text.cast("int")
    kind = F.when(signals >= 2, "evergreen").when((age <= 14) & ~evergreen_text, "fresh").otherwise("stale")
    return F.struct(kind.alias("class"), ((said <= 14) & (age >= 90)).alias("fake_fresh"))


def silence(stage: Column, last_activity: Column, pending: Column, now: Column, limits: dict[str, int] | None = None) -> Column:
    """"", active, silent or unconfirmed: an unset stage is applied, stages without a limit are over; silent beyond the stage's days, unconfirmed while a message waits."""
    table = F.create_map(*(F.lit(x) for kv in (limits or SILENCE).items() for x in kv))
    most = F.try_element_at(table, F.coalesce(F.nullif(stage, F.lit("")), F.lit("applied")))
    quiet = whole_days(now, last_activity) > most
    return F.when(most.isNull(), "").when(~quiet, "active").when(F.coalesce(pending, F.lit(False)), "unconfirmed").otherwise("silent")


def ghost_evidence(applications: DataFrame, reports: DataFrame, now: Column, ripe_days: int = 30) -> DataFrame:
    """job_id, silent, reports (matured), contributors (distinct users over both channels).

    applications: job_id, user_id, state; reports: job_id, user_id, applied_on.
    """
    a = applications.where("state = 'silent'").select("job_id", "user_id", F.lit("a").alias("channel"))
    r = reports.where(F.date_diff(now, "applied_on") >= ripe_days).select("job_id", "user_id", F.lit("r").alias("channel"))
    both = a.unionByName(r).distinct()
    return both.groupBy("job_id").agg(F.count_if(F.col("channel") == "a").alias("silent"), F.count_if(F.col("channel") == "r").alias("reports"), F.count_distinct("user_id").alias("contributors"))


def ghost_level(closed: Column, silent: Column, reports: Column, contributors: Column, gate: int = 3) -> Column:
    """none for closed postings and too few contributors; strong with both channels, weak with one."""
    return F.when(closed, "none").when(F.coalesce(contributors, F.lit(0)) < gate, "none").when((silent > 0) & (reports > 0), "strong").otherwise("weak")


def stage_counts(df: DataFrame, stage: str, groups: dict[str, list[str]]) -> DataFrame:
    """One row: a count for each group of stages."""
    return df.agg(*(F.count_if(F.col(stage).isin(*stages)).alias(g) for g, stages in groups.items()))


def latest_signal(messages: DataFrame, key: str, at: str, signal: str, manual: DataFrame, manual_at: str) -> DataFrame:
    """key, signal: of the newest classified message, unless a later manual entry silences it."""
    newest = messages.where(F.col(signal).isNotNull()).groupBy(key).agg(F.max_by(signal, at).alias(signal), F.max(at).alias("_at"))
    out = newest.join(manual.groupBy(key).agg(F.max(manual_at).alias("_m")), key, "left")
    return out.where(F.col("_m").isNull() | (F.col("_m") < F.col("_at"))).select(key, signal)


def vocabulary_gap(df: DataFrame, term: Column, known: DataFrame, k: int, spelling: Column) -> DataFrame:
    """term, n, spelling: the k commonest terms that the dictionary (column term) lacks, each in its most frequent spelling."""
    rows = df.select(term.alias("term"), spelling.alias("s")).where("term is not null")
    counts = rows.groupBy("term", "s").agg(F.count(F.lit(1)).alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.max_by("s", F.struct("c", "s")).alias("spelling"))
    return counts.join(known.select("term").distinct(), "term", "left_anti").orderBy(F.desc("n"), "term").limit(k)


def majority(df: DataFrame, key: str, value: str, least_share: float) -> DataFrame:
    """key, value, n, share: the commonest value of each key (ties to the greater) where its share suffices."""
    c = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    best = c.groupBy(key).agg(F.max(F.struct("c", value)).alias("b"), F.sum("c").alias("n"))
    return best.select(key, F.col("b").getField(value).alias(value), "n", (F.col("b.c") / F.col("n")).alias("share")).where(F.col("share") >= least_share)
