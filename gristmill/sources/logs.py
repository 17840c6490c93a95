"""Access logs and event files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a line of the published combined log format, each with its pattern; the request names a protocol.
FIELDS = (
    ("ip", r"(\S+)"), ("identity", r"\S+"), ("user", r"\S+"), ("time", r"\[([^\]]*)\]"), ("request", r'"([A-Z]+) ([^\s"]+) [A-Z]+/[0-9.]+"'),
    ("status", r"([0-9]{3})"), ("size", r"\S+"), ("referrer", r'"[^"]*"'), ("agent", r'"([^"]*)"'),
)
#: A further quoted field, the purpose of the request, may follow; what follows it does not matter.
LINE = "^" + " ".join(pattern for _, pattern in FIELDS) + r'(?: "([^"]*)")?'
#: Parts of names of crawlers, and what follows a name that ends in "bot" (or nothing).
BOTS = ("crawl", "spider", "slurp", "facebookexternalhit", "embedly", "prerender", "headlesschrome")
BOT_ENDS = ("/", ";", ")", " ", "-")


def parse_access(lines: DataFrame, column: str = "value") -> DataFrame:
    """ip, at, method, path, status, agent, purpose of the lines that are log lines; "-" counts as nothing."""
    part = lambda i: F.get("_f", F.lit(i - 1))
    none = lambda c: F.when((c != "") & (c != "-"), c)
    # One match a line gives all groups, joined by a character that no line holds; the generator keeps the planner from repeating it for each field.
    groups = F.split(F.regexp_replace(column, LINE + ".*$", "\u0001".join(f"${i}" for i in range(1, 8))), "\u0001", -1)
    rows = lines.where(F.col(column).rlike(LINE)).select(F.explode_outer(F.array(groups)).alias("_f"))
    return rows.select(
        part(1).alias("ip"), F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("at"), part(3).alias("method"), part(4).alias("path"), part(5).cast("int").alias("status"), none(part(6)).alias("agent"), none(part(7)).alias("purpose")
    )


def read_access(spark: SparkSession, path: str) -> DataFrame:
    """Rotated logs, plain or gzip."""
    return parse_access(spark.read.text(path))


def is_bot(agent: Column) -> Column:
    """Whether an agent has a crawler's name; no name is no crawler."""
    low = F.lower(F.coalesce(agent, F.lit("")))
    out = low.endswith("bot")
    for part in (*BOTS, *(f"bot{end}" for end in BOT_ENDS)):
        out = out | low.contains(part)
    return out


def viewed(method: Column, path: Column, status: Column, purpose: Column) -> Column:
    """Struct (kind, slug) of a view: a successful GET of one segment below /jobs/ (page) or /api/v1/jobs/ (api), not a prefetch; else null.

    The data of a page, at /__data.json below it, is the page; a query does not matter.
    """
    ok = (method == "GET") & status.between(200, 299) & purpose.isNull()
    plain = F.regexp_replace(F.substring_index(path, "?", 1), "/__data[.]json$", "")
    slug = F.regexp_extract(plain, "^/(?:api/v1/)?jobs/([^/]+)$", 1)
    kind = F.when(path.startswith("/api/"), "api").otherwise("page")
    return F.when(ok & (slug != ""), F.struct(kind.alias("kind"), slug.alias("slug")))


def visitor(ip: Column, agent: Column) -> Column:
    """Who views: the address with the agent's name."""
    return F.concat(ip, F.lit("\u0000"), F.coalesce(agent, F.lit("")))


def daily_viewers(views: DataFrame, day: Column, key: str, visitor: str, page: Column) -> DataFrame:
    """day, key, uniques, page_uniques: distinct visitors of any kind, and of pages (null page flags count as none)."""
    return views.groupBy(day.alias("day"), key).agg(F.count_distinct(visitor).alias("uniques"), F.count_distinct(F.when(page, F.col(visitor))).alias("page_uniques"))


def daily_from_arrays(events: DataFrame, day: Column, viewer: str, ids: str) -> DataFrame:
    """day, id, uniques: distinct viewers of each id of the array column."""
    rows = events.select(day.alias("day"), viewer, F.explode(ids).alias("id")).distinct()
    return rows.groupBy("day", "id").agg(F.count(F.lit(1)).alias("uniques"))


def read_events(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a JSON-lines path, and its (good, bad) counts.  Reading a path without a good row is the caller's error to raise: see checked()."""
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", f"{schema}, _bad string", options).alias("e")).select("e.*")
    counts = raw.agg(F.count_if(F.col("_bad").isNull()).alias("good"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))
    return raw.where("_bad is null").drop("_bad"), counts


def checked(counts: DataFrame) -> None:
    """Raise if there are bad rows only."""
    c = counts.first()
    if c["bad"] and not c["good"]:
        raise ValueError(f"no good row, {c['bad']} bad ones")


def list_records(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """name, slug of a list file: plain slugs, JSON objects with a name, or table rows of markup."""
    from gristmill.functions.text import plain_text, slug

    text = F.trim(F.col(column))
    if kind == "slugs":
        rows = lines.where((text != "") & ~text.startswith("#")).select(text.alias("name"))
    elif kind == "json":
        rows = lines.select(F.get_json_object(column, "$.name").alias("name")).where("name is not null")
    elif kind == "table":
        rows = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>"), F.lit(1))).alias("cell")).select(plain_text(F.col("cell")).alias("name")).where("name <> ''")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return rows.withColumn("slug", slug(F.col("name")))
