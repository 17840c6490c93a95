"""Queries: scans, filters, facets, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import facets, filters
from gristmill.operators.filters import SearchSpec
from gristmill.plans.frames import POSTINGS, SKILLS, WITH_COUNTRY, postings, skills, with_country
from gristmill.plans.registry import query
from gristmill.sources.tables import table


@query("facet_counts", f"""WITH {POSTINGS}, f AS (SELECT * FROM p WHERE closed IS NULL AND duplicate_of IS NULL AND NOT is_private AND category IN ('1-URGENT', '2-HIGH') AND amount >= 100000)
SELECT 'category' AS facet, category AS value, count(*) AS n FROM f GROUP BY category UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY status UNION ALL SELECT 'total', '', count(*) FROM f""")
def _(spark, sf):
    from gristmill.functions.predicates import listed

    spec = SearchSpec(include={"category": ["1-URGENT", "2-HIGH"]}, groups=[[filters.at_least("amount", 100000)]])
    found = filters.search(postings(spark, sf).where(listed()), spec)
    return facets.distribution(found.withColumn("total", F.lit("")), ["category", "status", "total"])


@query("scan_filtered", """SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_totalprice > 300000""")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' and o_totalprice > 300000").select("o_custkey")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("scan_keyset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 5000 ORDER BY o_orderkey LIMIT 50")
def _(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderkey > 5000").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("scan_composite_keyset", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey) > (700, 3, 10) AND l_orderkey < 12000 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 40")
def _(spark, sf):
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    after = F.struct(F.lit(700).cast("long"), F.lit(3), F.lit(10).cast("long"))
    rows = table(spark, sf, "lineitem").where((F.col("l_orderkey") >= 700) & (key > after) & (F.col("l_orderkey") < 12000))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(40)


@query("scan_prefix", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'blue ')")
def _(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").startswith("blue ")).select("p_partkey", "p_name")


@query("scan_batch_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_tax = 0.08)")
def _(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_quantity = 50 and l_tax = 0.08").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("scan_unnest_zip", "SELECT unnest([3, 1, 2]) AS k, unnest(['c', 'a', 'b']) AS v")
def _(spark, sf):
    return spark.range(1).select(F.inline(F.arrays_zip(F.array(F.lit(3), F.lit(1), F.lit(2)).alias("k"), F.array(F.lit("c"), F.lit("a"), F.lit("b")).alias("v"))))


@query("sample_by_hash", """WITH c AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || ':7') AS h FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey FROM c WHERE h < '40' ORDER BY h, o_orderkey LIMIT 200""")
def _(spark, sf):
    """A sampling operator: its limit is the feature."""
    from gristmill.operators.sampling import hash_sample

    return hash_sample(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", 0.25, 200, seed=7)


@query("filter_cnf", f"""WITH {WITH_COUNTRY}, {SKILLS} SELECT id FROM pc JOIN sk USING (id) WHERE (category = '1-URGENT' OR category = '3-MEDIUM') AND (list_contains(skills, 'Brand#2') OR list_contains(skills, 'Brand#7'))
AND NOT list_contains(countries, 'NATION_3') AND amount <= 250000 AND status <> 'P'""")
def _(spark, sf):
    rows = with_country(spark, sf).join(skills(spark, sf), "id")
    spec = SearchSpec(include={"category": ["1-URGENT", "3-MEDIUM"], "skills": ["Brand#2", "Brand#7"]}, exclude={"countries": ["NATION_3"], "status": ["P"]}, arrays=frozenset({"skills", "countries"}), groups=[[filters.at_most("amount", 250000)], []])
    return filters.search(rows, spec).select("id")


@query("filter_modifiers", f"""WITH {POSTINGS}, q AS (SELECT *, CASE WHEN id % 4 <> 0 THEN id % 12 END AS years, CASE WHEN id % 5 = 0 THEN 'senior' END AS seniority FROM p)
SELECT id FROM q WHERE (years <= 3 OR years IS NULL) AND (years >= 1 OR seniority IS NOT NULL) AND id NOT IN (5, 7, 11)""")
def _(spark, sf):
    k = F.col("id")
    rows = postings(spark, sf).withColumn("years", F.when(k % 4 != 0, k % 12)).withColumn("seniority", F.when(k % 5 == 0, F.lit("senior")))
    groups = [filters.bounded("years", "3", include_unspecified=True), filters.bounded("years", "1", upper=False, unless="seniority"), filters.bounded("years", "-1"), filters.bounded("years", "abc"), filters.ids_in("id", []), filters.ids_not_in("id", [5, 7, 11])]
    return rows.where(filters.all_of(groups)).select("id")


@query("filter_empty_word", f"""WITH {POSTINGS}, q AS (SELECT id, CASE WHEN id % 3 = 0 THEN [] WHEN id % 3 = 1 THEN ['eu'] ELSE NULL END AS regions FROM p)
SELECT id, 'any' AS how FROM q WHERE len(regions) = 0 OR list_contains(regions, 'eu') UNION ALL SELECT id, 'not' FROM q WHERE regions IS NULL OR len(regions) > 0""")
def _(spark, sf):
    k = F.col("id")
    rows = postings(spark, sf).select("id", F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("eu"))).alias("regions"))
    either = filters.any_of(filters.facet_group("regions", ["none", "eu"], array=True, empty_word=True))
    neither = filters.all_of(filters.facet_exclusions("regions", ["none"], array=True, empty_word=True))
    return rows.where(either).select("id", F.lit("any").alias("how")).unionByName(rows.where(neither).select("id", F.lit("not").alias("how")))


@query("filter_family", """SELECT CASE WHEN lower(trim(source)) IN ('src1') OR starts_with(lower(trim(source)), 'src1-') THEN 'src1' ELSE lower(trim(source)) END AS family, count(*) AS n
FROM (SELECT CASE WHEN doc_id % 2 = 0 AND source = 'src1' THEN ' SRC1-de' ELSE source END AS source FROM documents) GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.when((F.col("doc_id") % 2 == 0) & (F.col("source") == "src1"), F.lit(" SRC1-de")).otherwise(F.col("source")).alias("source"))
    return d.groupBy(filters.family(F.col("source"), ("src1",)).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_null_safe", """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS x, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'F' END AS y FROM orders) SELECT o_orderkey FROM a WHERE x IS DISTINCT FROM y""")
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k, F.when(k % 3 != 0, F.col("o_orderstatus")).alias("x"), F.when(k % 5 != 0, F.lit("F")).alias("y"))
    return rows.where(~F.col("x").eqNullSafe(F.col("y"))).select("o_orderkey")


@query("filter_overlap_or_empty", f"""WITH {SKILLS}, b AS (SELECT id, CASE WHEN id % 4 = 0 THEN [] ELSE skills END AS skills FROM sk) SELECT id FROM b WHERE list_has_any(skills, ['Brand#1', 'Brand#25']) OR len(skills) = 0""")
def _(spark, sf):
    b = skills(spark, sf).withColumn("skills", F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("skills")))
    return b.where(F.arrays_overlap("skills", F.array(F.lit("Brand#1"), F.lit("Brand#25"))) | (F.size("skills") == 0)).select("id")


@query("filter_regex", "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '(?i)^[12]-[UH]') AND NOT regexp_matches(CAST(o_custkey AS VARCHAR), '^[0-4]+$')")
def _(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority").rlike("(?i)^[12]-[UH]") & ~F.col("o_custkey").cast("string").rlike("^[0-4]+$")).select("o_orderkey")


@query("filter_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Wid%'")
def _(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%Wid%")).select("p_partkey", "p_name")


@query("filter_none_of", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> ALL(['de', 'fr'])")
def _(spark, sf):
    d = table(spark, sf, "documents").where(~F.coalesce(F.col("lang").isin("de", "fr"), F.lit(False)))
    return d.join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


HOSTS = "h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)"


@query("join_domain_suffix", f"""WITH {HOSTS}, d AS (SELECT unnest(['example.com', 'example.net', 'nowhere.org']) AS domain) SELECT domain, count(*) AS n FROM h JOIN d ON host = domain OR ends_with(host, '.' || domain) GROUP BY domain""")
def _(spark, sf):
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))
    known = spark.createDataFrame([("example.com",), ("example.net",), ("nowhere.org",)], "domain string")
    # Hosts are taken apart into their suffixes, so that the join is by equality.
    return hosts.select(F.explode(filters.suffixes("host")).alias("domain")).join(F.broadcast(known), "domain").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("filter_withheld", """SELECT CASE WHEN doc_id % 11 = 0 OR trim(text) = '' THEN 'no_body' WHEN doc_id % 40 > CASE source WHEN 'src1' THEN 5 WHEN 'src2' THEN 10 ELSE 30 END THEN 'unseen' END AS why, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, sf):
    from gristmill.functions.predicates import withheld

    k, now = F.col("doc_id"), F.lit("2024-02-01").cast("date")
    why = withheld(F.when(k % 11 != 0, F.col("text")), F.date_sub(now, (k % 40).cast("int")), F.col("source"), {"src1": 5, "src2": 10}, 30, now)
    return table(spark, sf, "documents").select(why.alias("why")).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query("search_text", """SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'blue') AND contains(lower(p_name), 'bolt')) OR contains(lower(p_name), 'red ring') OR contains(lower(p_type), 'promo') AND contains(lower(p_type), 'promo') AND p_brand = 'Brand#3'""")
def _(spark, sf):
    p = table(spark, sf, "part")
    plain = filters.text_matches(filters.parse_query('title:blue bolt OR title:"red ring"'), {"title": F.col("p_name"), "type": F.col("p_type")})
    boxed, text = filters.parse_box("brand:Brand#3 promo", keys=("brand",))
    narrow = filters.text_matches([filters.Alternative(text)], {"type": F.col("p_type")}) & F.col("p_brand").isin(*boxed["brand"])
    return p.where(plain | narrow).select("p_partkey")


@query("facet_disjunctive", f"""WITH {WITH_COUNTRY}, s AS (SELECT *, category IN ('1-URGENT', '2-HIGH') AS g1, list_contains(countries, 'NATION_1') OR list_contains(countries, 'NATION_2') AS g2, status <> 'P' AS g3 FROM pc WHERE amount >= 50000)
SELECT 'category' AS facet, category AS value, count(*) AS n FROM s WHERE g2 AND g3 GROUP BY ALL
UNION ALL SELECT 'countries', c, count(*) FROM (SELECT unnest(countries) AS c FROM s WHERE g1 AND g3) GROUP BY ALL
UNION ALL SELECT 'status', status, count(*) FROM s WHERE g1 AND g2 GROUP BY ALL
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM s WHERE g1 AND g2 AND g3 GROUP BY ALL
UNION ALL SELECT 'total', '', count(*) FROM s WHERE g1 AND g2 AND g3""")
def _(spark, sf):
    spec = SearchSpec(include={"category": ["1-URGENT", "2-HIGH"], "countries": ["NATION_1", "NATION_2"]}, exclude={"status": ["P"]}, arrays=frozenset({"countries"}), groups=[[filters.at_least("amount", 50000)]])
    return facets.disjunctive(with_country(spark, sf), spec, ["category", "countries", "status", "c_mktsegment"])


@query("facet_numeric", "SELECT 'l_quantity' AS attribute, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem")
def _(spark, sf):
    return facets.numeric_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])


@query("facet_floor", f"""WITH {POSTINGS} SELECT company, CASE WHEN count(*) < 12 THEN -1 ELSE count(*) END AS n FROM p GROUP BY company""")
def _(spark, sf):
    return facets.floored(postings(spark, sf).groupBy("company").agg(F.count(F.lit(1)).alias("n")), 12)


@query("facet_distinct_top", f"""WITH {POSTINGS}, c AS (SELECT company, count(*) AS n FROM p WHERE status = 'O' GROUP BY company) SELECT company, n, (SELECT count(*) FROM c) AS n_distinct FROM c ORDER BY n DESC, company LIMIT 50""")
def _(spark, sf):
    return facets.distinct_and_top(postings(spark, sf).where("status = 'O'"), "company", 50)


@query("facet_snapshot", f"""WITH {WITH_COUNTRY}, {SKILLS}, l AS (SELECT * FROM pc WHERE closed IS NULL AND duplicate_of IS NULL AND NOT is_private)
SELECT 'category' AS facet, category AS value, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM l GROUP BY ALL
UNION ALL SELECT 'countries', c, count(*) FROM (SELECT unnest(countries) AS c FROM l) GROUP BY ALL UNION ALL SELECT 'skills', s, count(*) FROM (SELECT unnest(skills) AS s FROM l JOIN sk USING (id)) GROUP BY ALL""")
def _(spark, sf):
    from gristmill.functions.predicates import listed

    rows = with_country(spark, sf).where(listed()).join(skills(spark, sf), "id", "left")
    return facets.distribution(rows, ["category", "status", "countries", "skills"], frozenset({"countries", "skills"}))


@query("facet_cooccurrence", """WITH d AS (SELECT DISTINCT l_orderkey AS doc, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT a.item, b.item AS neighbour, count(*) AS n FROM d a JOIN d b USING (doc) WHERE a.item <> b.item GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY n DESC, neighbour) AS INTEGER) AS rank FROM c) SELECT item, neighbour, n, rank FROM r WHERE rank <= 24""")
def _(spark, sf):
    li, pa = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "part").select("p_partkey", "p_brand")
    return facets.cooccurrence(li.join(pa, li.l_partkey == pa.p_partkey), "l_orderkey", "p_brand")


@query("facet_presence", """WITH j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{"k":null}' WHEN 2 THEN '{"k":""}' WHEN 3 THEN '{"k":"v"}' ELSE props END AS props FROM events)
SELECT CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' WHEN 2 THEN 'empty' ELSE 'value' END AS state, count(*) AS n FROM j GROUP BY 1""")
def _(spark, sf):
    k = F.col("event_id") % 5
    props = F.when(k == 0, F.lit("{}")).when(k == 1, F.lit('{"k":null}')).when(k == 2, F.lit('{"k":""}')).when(k == 3, F.lit('{"k":"v"}')).otherwise(F.col("props"))
    return table(spark, sf, "events").select(facets.presence(props, "k").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("search_alternatives", """SELECT 'n' AS facet, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 OR o_orderpriority = '1-URGENT' UNION ALL
SELECT o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 OR o_orderpriority = '1-URGENT' GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").where("(o_orderstatus = 'F' and o_totalprice > 400000) or o_orderpriority = '1-URGENT'")
    return rows.select(F.explode(F.array(F.lit("n"), "o_orderpriority")).alias("facet")).groupBy("facet").agg(F.count(F.lit(1)).alias("n"))


@query("sort_allowed", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("sort_view_bucket", "SELECT user_id, CASE WHEN count(*) < 5 THEN 0 ELSE CAST(1 + floor(ln(count(*) / 5.0) / ln(1.25)) AS BIGINT) END AS bucket FROM events GROUP BY user_id")
def _(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(n < 5, F.lit(0).cast("long")).otherwise((1 + F.floor(F.log(n / 5.0) / F.log(F.lit(1.25)))).cast("long")).alias("bucket"))


@query("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer) UNION ALL
SELECT 'distinct', count(*) FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    parts = {"union": f.unionAll(c.select("k")), "distinct": o.select("o_custkey").distinct(), "except": c.select("k").exceptAll(f.distinct()), "intersect": c.where("c_acctbal > 0").select("k").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("threshold_scan", f"""WITH {SKILLS} SELECT id, CAST(round(100.0 * len(list_filter(skills, lambda s: s IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6'))) / len(skills)) AS BIGINT) AS percent FROM sk WHERE round(100.0 * len(list_filter(skills, lambda s: s IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6'))) / len(skills)) >= 50""")
def _(spark, sf):
    """The whole superset by a filter: no early stop, no depth limit."""
    from gristmill.operators.match import match_percent

    held = F.array(*(F.lit(f"Brand#{i}") for i in range(1, 7)))
    return skills(spark, sf).select("id", match_percent(F.col("skills"), held).alias("percent")).where("percent >= 50")


@query("filter_open_guard", f"""WITH {POSTINGS}, d AS (SELECT id, category, CASE WHEN id % 5 <> 0 THEN closed IS NOT NULL END AS is_closed, CASE WHEN id % 7 <> 0 THEN duplicate_of IS NOT NULL END AS is_duplicate FROM p)
SELECT category, count(*) AS n FROM d WHERE category IN ('1-URGENT', '5-LOW') AND coalesce(is_closed, false) = false AND coalesce(is_duplicate, false) = false GROUP BY category""")
def _(spark, sf):
    """Documents without a marker pass the guard."""
    k = F.col("id")
    d = postings(spark, sf).select("id", "category", F.when(k % 5 != 0, F.col("closed").isNotNull()).alias("is_closed"), F.when(k % 7 != 0, F.col("duplicate_of").isNotNull()).alias("is_duplicate"))
    spec = SearchSpec(include={"category": ["1-URGENT", "5-LOW"]}, groups=filters.open_only([]))
    return filters.search(d, spec).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
