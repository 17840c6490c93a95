"""Binding of the posting roles onto the driver's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.tables import table

REASONS = ("employer_closed", "feed_removed", "probe_expired", "unseen", "swept", "merged")
NOW, BEFORE = "1999-06-01", "1999-05-02"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings from orders: one row an order, with days and flags derived from its key."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    created = F.timestamp_add("DAY", (k % 7).cast("int"), F.col("o_orderdate"))
    closed = F.timestamp_add("DAY", (k % 7 + 10 + k % 50).cast("int"), F.col("o_orderdate"))
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("posted"), created.alias("created"),
        F.when(F.col("o_orderstatus") == "F", closed).alias("closed"), F.element_at(F.array(*map(F.lit, REASONS)), (k % 6 + 1).cast("int")).alias("reason"),
        (k % 97 == 0).alias("is_private"), F.when(k % 13 == 0, k - 1).alias("duplicate_of"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"),
    )


#: The same in SQL: a first member for a WITH list.
POSTINGS = """p AS (SELECT o_orderkey AS id, o_custkey AS company, o_orderpriority AS category, o_orderdate AS posted, o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS created,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 7 + 10 + o_orderkey % 50 AS INTEGER)) END AS closed,
 (['employer_closed', 'feed_removed', 'probe_expired', 'unseen', 'swept', 'merged'])[o_orderkey % 6 + 1] AS reason,
 o_orderkey % 97 = 0 AS is_private, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 END AS duplicate_of, o_totalprice AS amount, o_orderstatus AS status FROM orders)"""


def with_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the array column countries: the customer's nation, and its region's name for every third order."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    # Nations and regions are fixed dimensions; customers are joined as the planner sees fit.
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    p = postings(spark, sf_dir)
    both = F.when(F.col("id") % 3 == 0, F.array("n_name", "r_name")).otherwise(F.array("n_name"))
    return p.join(cust, p.company == cust.c_custkey).withColumn("countries", both).drop("c_custkey")


WITH_COUNTRY = (
    POSTINGS
    + """, pc AS (SELECT p.*, c_mktsegment, n_name, r_name, CASE WHEN id % 3 = 0 THEN [n_name, r_name] ELSE [n_name] END AS countries FROM p JOIN customer ON company = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
)


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, skills: the distinct brands of an order's parts."""
    li, pa = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.select("l_orderkey", "l_partkey").join(pa.select("p_partkey", "p_brand"), li.l_partkey == pa.p_partkey)
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("p_brand")).alias("skills"))


SKILLS = """sk AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT p_brand)) AS skills FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""
