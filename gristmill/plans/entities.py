"""Queries: entity resolution, matching, vectors, evidence, mining and text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import times
from gristmill.operators import evidence, match, mining, resolve, sampling
from gristmill.plans.frames import POSTINGS, SKILLS, WITH_COUNTRY, postings, skills, with_country
from gristmill.plans.registry import query
from gristmill.session import ship
from gristmill.sources.tables import table


@query("dedup_role", f"""WITH {POSTINGS}, c AS (SELECT *, CASE WHEN id % 9 = 0 THEN '' ELSE category || status || CAST(id % 4 AS VARCHAR) END AS fp FROM p), m AS (SELECT company, fp, min(id) FILTER (closed IS NULL) AS canon FROM c GROUP BY ALL)
SELECT id, CASE WHEN c.fp <> '' AND canon <> id THEN canon END AS duplicate_of_role FROM c JOIN m ON c.company = m.company AND c.fp = m.fp""")
def _(spark, sf):
    k = F.col("id")
    rows = postings(spark, sf).withColumn("fp", F.when(k % 9 == 0, F.lit("")).otherwise(F.concat("category", "status", (k % 4).cast("string"))))
    return resolve.role_collapse(rows, "company", "fp").select("id", "duplicate_of_role")


#: Titles from parts: aggregators' are decorated, shortened or equal.
TITLED = """t AS (SELECT p_partkey AS id, CAST(substr(p_brand, 7) AS INTEGER) % 5 AS company, p_name || ' ' || lower(p_type) AS base, [CAST(p_size % 3 AS VARCHAR)] AS countries FROM part),
g AS (SELECT id, company, CASE id % 6 WHEN 0 THEN upper(base) WHEN 1 THEN base || ' - Remote' WHEN 2 THEN split_part(base, ' ', 1) || ' ' || split_part(base, ' ', 2) ELSE base || ' x' END AS title, CASE WHEN id % 7 = 0 THEN [] ELSE countries END AS countries FROM t WHERE id % 2 = 0),
b AS (SELECT id, company, base AS title, countries FROM t WHERE id % 2 = 1),
gk AS (SELECT *, lower(title) AS k1, CASE WHEN title LIKE '% - %' THEN lower(split_part(title, ' - ', 1)) ELSE lower(title) END AS k2 FROM g), bk AS (SELECT *, lower(title) AS k1 FROM b)"""


def _titled(spark, sf):
    p = table(spark, sf, "part")
    base = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    t = p.select(F.col("p_partkey").alias("id"), (F.substring("p_brand", 7, 9).cast("int") % 5).alias("company"), base.alias("base"), F.array((F.col("p_size") % 3).cast("string")).alias("countries"))
    k = F.col("id") % 6
    short = F.concat_ws(" ", F.split_part("base", F.lit(" "), F.lit(1)), F.split_part("base", F.lit(" "), F.lit(2)))
    title = F.when(k == 0, F.upper("base")).when(k == 1, F.concat("base", F.lit(" - Remote"))).when(k == 2, short).otherwise(F.concat("base", F.lit(" x")))
    agg = t.where("id % 2 = 0").withColumn("title", title).withColumn("countries", F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("countries")))
    return agg, t.where("id % 2 = 1").withColumnRenamed("base", "title")


@query("dedup_twins", f"""WITH {TITLED}, c AS (SELECT g.id, bk.id AS twin, 1 AS tier FROM gk g JOIN bk ON g.company = bk.company AND g.k1 = bk.k1 WHERE list_has_any(g.countries, bk.countries) OR len(g.countries) = 0
UNION ALL SELECT g.id, bk.id, 2 FROM gk g JOIN bk ON g.company = bk.company AND g.k2 = bk.k1 WHERE list_has_any(g.countries, bk.countries) OR len(g.countries) = 0
UNION ALL SELECT g.id, bk.id, 3 FROM gk g JOIN bk ON g.company = bk.company WHERE (list_has_any(g.countries, bk.countries) OR len(g.countries) = 0) AND len(list_distinct(string_split(g.k1, ' '))) >= 2 AND list_has_all(string_split(bk.k1, ' '), string_split(g.k1, ' '))
 AND len(list_distinct(list_filter(string_split(bk.k1, ' '), lambda w: NOT list_contains(string_split(g.k1, ' '), w)))) > 0),
r AS (SELECT id, tier, twin, row_number() OVER (PARTITION BY id ORDER BY tier, twin) AS rn FROM c) SELECT id, twin, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'normalised' ELSE 'subset' END AS how FROM r WHERE rn = 1""")
def _(spark, sf):
    agg, ats = _titled(spark, sf)
    return resolve.twins(agg.select("id", "company", "title", "countries"), ats.select("id", "company", "title", "countries"))


DOC_TOKENS = """d AS (SELECT doc_id, lang, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: len(w) > 3)) AS t FROM documents), x AS (SELECT doc_id, lang, len(t) AS n, unnest(t) AS w FROM d)"""


@query("dedup_similar_pairs", f"""WITH {DOC_TOKENS} SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS similarity FROM x a JOIN x b ON a.lang = b.lang AND a.w = b.w AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.7""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", tx.signature(F.col("text")).alias("t"))
    return resolve.similar_pairs(d, "doc_id", ["lang"], "t", 0.7).withColumn("similarity", F.round("similarity", 6))


@query("dedup_fuzzy", f"""WITH d AS (SELECT doc_id, source, lang, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: len(w) > 3)) AS t, count(*) OVER (PARTITION BY source, lang) AS bucket FROM documents), x AS (SELECT doc_id, source, lang, len(t) AS n, unnest(t) AS w FROM d WHERE bucket BETWEEN 2 AND 200),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.source = b.source AND a.lang = b.lang AND a.w = b.w AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8), m AS (SELECT b AS doc_id, min(a) AS duplicate_of_fuzzy FROM p GROUP BY b)
SELECT doc_id, bucket BETWEEN 2 AND 200 AS judged, duplicate_of_fuzzy FROM d LEFT JOIN m USING (doc_id)""")
def _(spark, sf):
    return resolve.fuzzy_collapse(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id", "source", "lang", "text", 0.8, 200).select("doc_id", "judged", "duplicate_of_fuzzy")


@query("dedup_summaries", """WITH d AS (SELECT doc_id AS id, source AS company, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: len(w) > 3)) AS t, string_split(lower(text), ' ')[1:12] AS tw FROM documents), x AS (SELECT id, company, tw, len(t) AS n, unnest(t) AS w FROM d),
p AS (SELECT a.id AS short, b.id AS "full", count(*) AS s, any_value(a.n) AS n, any_value(a.tw) AS tw, any_value(b.tw) AS tw2 FROM x a JOIN x b ON a.company = b.company AND a.w = b.w AND a.n <= b.n * 0.6 GROUP BY a.id, b.id), k AS (SELECT short, "full", count(*) OVER (PARTITION BY short) AS c FROM p WHERE s >= 25 AND s >= n * 0.5 AND list_has_any(tw, tw2))
SELECT short, "full" FROM k WHERE c = 1""")
def _(spark, sf):
    """Half of the tokens instead of the default 0.8: the documents hold few summaries."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("company"), tx.signature(F.col("text")).alias("t"), F.slice(F.split(F.lower("text"), " "), 1, 12).alias("tw"))
    return resolve.summaries(d, "id", "company", "t", "tw", share=0.5)


@query("dedup_effective", f"""WITH {POSTINGS} SELECT id, coalesce(CASE WHEN id % 5 = 0 THEN id - 2 END, CASE WHEN id % 3 = 0 THEN id - 1 END, CASE WHEN id % 2 = 0 THEN id - 3 END) AS duplicate_of FROM p""")
def _(spark, sf):
    k = F.col("id")
    rows = postings(spark, sf).select("id", F.when(k % 5 == 0, k - 2).alias("duplicate_of_aggregator"), F.when(k % 3 == 0, k - 1).alias("duplicate_of_role"), F.when(k % 2 == 0, k - 3).alias("duplicate_of_fuzzy"))
    return resolve.effective(rows).select("id", "duplicate_of")


@query("dedup_verdict", f"""WITH {POSTINGS} SELECT id, CASE WHEN id % 3 <> 2 THEN CASE WHEN id % 3 = 0 THEN id - 1 END ELSE duplicate_of END AS marker FROM p""")
def _(spark, sf):
    k = F.col("id")
    p = postings(spark, sf)
    old = p.select("id", F.col("duplicate_of").alias("marker"))
    verdict = p.where(k % 3 != 2).select("id", F.lit(True).alias("judged"), F.when(k % 3 == 0, k - 1).alias("marker"))
    return resolve.applied_verdict(old, verdict, "id", "marker")


@query("dedup_clusters", """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), x AS (SELECT id, p_brand, len(t) AS n, unnest(t) AS w FROM p),
e AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.p_brand = b.p_brand AND a.w = b.w AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.4),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS id, a AS v FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.v = u.a) SELECT id, min(v) AS cluster FROM r GROUP BY id""")
def _(spark, sf):
    """Clusters of a brand's parts whose words have a Jaccard similarity of 0.4."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("t"))
    return resolve.similar_clusters(p, "p_partkey", ["p_brand"], "t", 0.4)


@query("company_merge", "WITH o AS (SELECT CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 3 ELSE o_custkey END AS company FROM orders) SELECT company, count(*) AS n FROM o GROUP BY company")
def _(spark, sf):
    alias = table(spark, sf, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - 3).alias("canonical"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("company"))
    return resolve.merged_companies(o, alias, "company").groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("host_twins", """WITH h AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^(www|m)\\.', '') AS host, CASE page_id % 3 WHEN 0 THEN 'a-b' WHEN 1 THEN 'ab' ELSE 'c' END AS slug FROM pages)
SELECT host, array_to_string(list_sort(list(slug)), ',') AS slugs FROM h GROUP BY host HAVING count(DISTINCT replace(slug, '-', '')) > 1""")
def _(spark, sf):
    k = F.col("page_id") % 3
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1), r"^(www|m)\.", "")
    h = table(spark, sf, "pages").select(host.alias("host"), F.when(k == 0, "a-b").when(k == 1, "ab").otherwise("c").alias("slug"))
    return resolve.host_twins(h, "host", "slug").withColumn("slugs", F.array_join("slugs", ","))


@query("match_percent", f"WITH {SKILLS} SELECT id, CAST(round(100.0 * len(list_filter(skills, lambda s: s IN ('Brand#1', 'Brand#5', 'Brand#9'))) / len(skills)) AS BIGINT) AS percent FROM sk")
def _(spark, sf):
    return skills(spark, sf).select("id", match.match_percent(F.col("skills"), F.array(F.lit("brand#1"), F.lit("BRAND#5"), F.lit("Brand#9"))).alias("percent"))


@query("match_cosine", f"""WITH {SKILLS} SELECT id, round(len(list_intersect(skills, ['Brand#1', 'Brand#5', 'Brand#9', 'Brand#11'])) / (sqrt(4) * sqrt(len(skills) + power(4 * greatest(len(skills), 6), 2))), 9) AS cosine FROM sk""")
def _(spark, sf):
    held = F.array(*(F.lit(f"Brand#{i}") for i in (1, 5, 9, 11)))
    return skills(spark, sf).select("id", F.round(match.ballast_cosine(F.col("skills"), held), 9).alias("cosine"))


@query("match_adjacent", f"""WITH {SKILLS}, l AS (SELECT id, list_transform(skills, lambda s: lower(s)) AS s FROM sk), e AS (SELECT id, s, list_filter(s, lambda w: w IN ('brand#1', 'brand#5')) AS exact, list_filter(s, lambda w: w IN ('brand#2', 'brand#6')) AS via FROM l)
SELECT id, len(exact) AS exact, len(via) AS adjacent, len(s) - len(exact) - len(via) AS missing, CAST(round((len(exact) + 0.5 * len(via)) * 100.0 / len(s)) AS BIGINT) AS coverage FROM e""")
def _(spark, sf):
    m = match.job_match(F.col("skills"), F.array(F.lit("Brand#1"), F.lit("Brand#5")), {"brand#2": ["brand#1"], "brand#6": ["brand#5", "brand#7"], "brand#8": ["brand#9"]})
    out = skills(spark, sf).select("id", m.alias("m"))
    return out.select("id", *(F.size(f"m.{c}").cast("long").alias(c) for c in ("exact", "adjacent", "missing")), "m.coverage")


@query("match_bundle", f"WITH {SKILLS} SELECT id, len(list_intersect(skills, ['Brand#1', 'Brand#2', 'Brand#3'])) * 100 >= 3 * 60 AS covered FROM sk")
def _(spark, sf):
    return skills(spark, sf).select("id", match.covered(F.col("skills"), F.array(*(F.lit(f"Brand#{i}") for i in (1, 2, 3)))).alias("covered"))


@query("market_coverage", f"WITH {SKILLS} SELECT count(*) AS total, count(*) FILTER (WHERE list_has_any(skills, ['Brand#1', 'Brand#2'])) AS covered, round(count(*) FILTER (WHERE list_has_any(skills, ['Brand#1', 'Brand#2'])) * 100.0 / count(*), 2) AS percent FROM sk")
def _(spark, sf):
    return match.market_coverage(skills(spark, sf), ["Brand#1", "Brand#2"])


@query("coverage_gaps", f"WITH {SKILLS} SELECT skill, count(*) AS unlocked FROM (SELECT unnest(skills) AS skill FROM sk WHERE NOT list_has_any(skills, ['Brand#1', 'Brand#2'])) GROUP BY skill ORDER BY unlocked DESC, skill LIMIT 10")
def _(spark, sf):
    return match.coverage_gaps(skills(spark, sf), ["Brand#1", "Brand#2"], 10)


@query("vector_nearest", """WITH q AS (SELECT vec_id AS query, label AS ql, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query, vec_id AS doc, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS distance FROM q JOIN embeddings ON label <> ql AND vec_id <> query),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS INTEGER) AS rank FROM d) SELECT query, doc, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""")
def _(spark, sf):
    ship(spark)
    e = table(spark, sf, "embeddings")
    return match.nearest(e, e.where("vec_id % 50 = 0"), 10, "vec_id", "label", "embedding").withColumn("distance", F.round("distance", 6))


@query("reality_class", """WITH j AS (SELECT event_id, date_diff('day', ts - to_days(CAST(event_id % 120 AS INTEGER)), TIMESTAMP '2024-01-31') AS dummy, floor(epoch(TIMESTAMP '2024-01-31' - (ts - to_days(CAST(event_id % 120 AS INTEGER)))) / 86400) AS age, floor(epoch(TIMESTAMP '2024-01-31' - ts) / 86400) AS said, event_id % 9 AS rep, event_id % 7 AS mass, event_id % 11 = 0 AS ev FROM events),
c AS (SELECT *, CAST(age >= 90 AS INTEGER) + CAST(rep - mass >= 3 AS INTEGER) + CAST(mass >= 5 AS INTEGER) + CAST(ev AS INTEGER) AS s FROM j)
SELECT CASE WHEN s >= 2 THEN 'evergreen' WHEN age <= 14 AND NOT ev THEN 'fresh' ELSE 'stale' END AS class, said <= 14 AND age >= 90 AS fake_fresh, count(*) AS n FROM c GROUP BY ALL""")
def _(spark, sf):
    k = F.col("event_id")
    created = F.timestamp_add("DAY", (-(k % 120)).cast("int"), F.col("ts"))
    r = evidence.reality(created, F.col("ts"), k % 9, k % 7, k % 11 == 0, F.lit("2024-01-31").cast("timestamp"))
    return table(spark, sf, "events").select(r.alias("r")).groupBy("r.class", "r.fake_fresh").agg(F.count(F.lit(1)).alias("n"))


@query("silence_state", """WITH j AS (SELECT [NULL, 'applied', 'interview', 'offer', 'hired', ''][event_id % 6 + 1] AS stage, floor(epoch(TIMESTAMP '2024-02-05' - ts) / 86400) AS d, event_id % 4 = 0 AS pending FROM events), m AS (SELECT *, CASE coalesce(nullif(stage, ''), 'applied') WHEN 'applied' THEN 21 WHEN 'screening' THEN 18 WHEN 'interview' THEN 15 WHEN 'test' THEN 12 WHEN 'offer' THEN 5 END AS most FROM j)
SELECT CASE WHEN most IS NULL THEN '' WHEN NOT d > most THEN 'active' WHEN pending THEN 'unconfirmed' ELSE 'silent' END AS state, count(*) AS n FROM m GROUP BY 1""")
def _(spark, sf):
    k = F.col("event_id")
    stage = F.element_at(F.array(F.lit(None).cast("string"), *(F.lit(s) for s in ("applied", "interview", "offer", "hired", ""))), (k % 6 + 1).cast("int"))
    return table(spark, sf, "events").select(evidence.silence(stage, F.col("ts"), k % 4 == 0, F.lit("2024-02-05").cast("timestamp")).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("ghost_evidence", """WITH a AS (SELECT DISTINCT event_id % 50 AS job_id, user_id, 'a' AS channel FROM events WHERE event_type = 'error'), r AS (SELECT DISTINCT event_id % 50 AS job_id, user_id, 'r' AS channel FROM events WHERE event_type = 'click' AND date_diff('day', CAST(ts AS DATE), DATE '2024-02-10') >= 30), b AS (SELECT * FROM a UNION ALL SELECT * FROM r)
SELECT job_id, count(*) FILTER (WHERE channel = 'a') AS silent, count(*) FILTER (WHERE channel = 'r') AS reports, count(DISTINCT user_id) AS contributors, CASE WHEN job_id % 10 = 0 THEN 'none' WHEN count(DISTINCT user_id) < 3 THEN 'none' WHEN count(*) FILTER (WHERE channel = 'a') > 0 AND count(*) FILTER (WHERE channel = 'r') > 0 THEN 'strong' ELSE 'weak' END AS level FROM b GROUP BY job_id""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("job_id", F.col("event_id") % 50)
    a = e.where("event_type = 'error'").select("job_id", "user_id", F.lit("silent").alias("state"))
    r = e.where("event_type = 'click'").select("job_id", "user_id", F.to_date("ts").alias("applied_on"))
    out = evidence.ghost_evidence(a, r, F.lit("2024-02-10").cast("date"))
    return out.withColumn("level", evidence.ghost_level(F.col("job_id") % 10 == 0, F.col("silent"), F.col("reports"), F.col("contributors")))


#: What pages say, by the remainder of their number, and the reason that follows from it.
SAID = ("This position has been filled.", "12 jobs found", "this role is no longer open to you", "Sorry, applications are closed", "Diese Stelle ist bereits besetzt", "we listen to our clients", "Вакансия закрыта", "the job ad is no longer active", "search for jobs", "")


@query("liveness", f"""WITH j AS (SELECT [200, 404, 500, 200, 301, 410, 204][page_id % 7 + 1] AS status, CASE WHEN page_id % 11 = 0 THEN url || '&error=true' ELSE url END AS url, page_id % 11 = 0 AS err, page_id % 10 AS said, page_id % 13 = 0 AS shell FROM pages),
r AS (SELECT CASE WHEN status IN (404, 410) THEN 'http_gone' WHEN status NOT BETWEEN 200 AND 299 THEN '' WHEN err AND regexp_matches(url, '[?&]error=true') THEN 'expired_url' WHEN said IN (0, 2, 3, 4, 6, 7) THEN 'expired_body' WHEN said = 1 THEN 'listing_page' WHEN shell THEN 'insufficient_content' END AS reason FROM j)
SELECT CASE WHEN reason = '' THEN 'uncertain' WHEN reason IS NULL THEN 'live' ELSE 'expired' END AS verdict, nullif(reason, '') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, sf):
    """Shells have a long head without visible text; other pages have their own text behind what they say."""
    k = F.col("page_id")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    shell = F.concat(F.lit("<script>"), F.repeat(F.lit("x = 1; "), F.lit(200)), F.lit("</script>"))
    body = F.concat(F.lit("<p>"), of(SAID, 10), F.lit("</p>"), F.when(k % 13 == 0, shell).otherwise(F.concat("html", F.lit("<p>"), F.repeat(F.lit("more words "), F.lit(40)))))
    url = F.when(k % 11 == 0, F.concat("url", F.lit("&error=true"))).otherwise(F.col("url"))
    live = evidence.liveness(of((200, 404, 500, 200, 301, 410, 204), 7), url, body)
    return table(spark, sf, "pages").select(live.alias("l")).groupBy("l.verdict", "l.reason").agg(F.count(F.lit(1)).alias("n"))


@query("stage_counts", "SELECT count(*) FILTER (WHERE event_type IN ('view', 'click')) AS open, count(*) FILTER (WHERE event_type = 'purchase') AS won, count(*) FILTER (WHERE event_type IN ('error')) AS lost FROM events")
def _(spark, sf):
    return evidence.stage_counts(table(spark, sf, "events"), "event_type", {"open": ["view", "click"], "won": ["purchase"], "lost": ["error"]})


@query("latest_signal", """WITH n AS (SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS last FROM events WHERE event_type <> 'view' GROUP BY user_id), m AS (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY user_id) SELECT n.user_id, event_type FROM n LEFT JOIN m USING (user_id) WHERE m IS NULL OR m < last""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return evidence.latest_signal(e.where("event_type <> 'view'"), "user_id", "ts", "event_type", e.where("event_type = 'view' and user_id % 2 = 0"), "ts")


@query("vocabulary_gap", """WITH w AS (SELECT trim(regexp_replace(lower(p_name), '[-_ ]+', ' ', 'g')) AS term, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS s FROM part), c AS (SELECT term, s, count(*) AS c FROM w GROUP BY ALL)
SELECT term, CAST(sum(c) AS BIGINT) AS n, arg_max(s, (c, s)) AS spelling FROM c WHERE term NOT LIKE 'blue %' GROUP BY term ORDER BY n DESC, term LIMIT 15""")
def _(spark, sf):
    p = table(spark, sf, "part")
    known = p.where("p_name like 'blue %'").select(tx.skill_phrase(F.col("p_name")).alias("term"))
    return evidence.vocabulary_gap(p, tx.skill_phrase(F.col("p_name")), known, 15, F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")))


@query("geo_majority", """WITH c AS (SELECT c_mktsegment, c_nationkey % 3 AS region, count(*) AS c FROM customer GROUP BY ALL), t AS (SELECT c_mktsegment, arg_max(region, (c, region)) AS region, CAST(sum(c) AS BIGINT) AS n, max(c) AS top FROM c GROUP BY 1) SELECT c_mktsegment, region, n, round(top / n, 6) AS share FROM t WHERE top / n >= 0.34""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", (F.col("c_nationkey") % 3).alias("region"))
    return evidence.majority(c, "c_mktsegment", "region", 0.34).withColumn("share", F.round("share", 6))


@query("word_groups", """WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, unnest(list_concat(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i:i + 1]) ELSE [] END, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) ELSE [] END)) AS g FROM w)
SELECT array_to_string(g, ' ') AS words, count(*) AS df, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS sources FROM g WHERE g[1] NOT IN ('the', 'of', 'and', 'a') AND g[-1] NOT IN ('the', 'of', 'and', 'a') GROUP BY 1 HAVING count(*) >= 2""")
def _(spark, sf):
    out = mining.word_groups(table(spark, sf, "benchmark"), "item_id", F.col("text"), stop=("the", "of", "and", "a"), sources="item_id")
    return out.withColumn("sources", F.array_join("sources", ","))


@query("title_suggestions", """WITH t AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' - remote' WHEN 2 THEN '- ' || p_name || ', berlin' ELSE p_name END AS title FROM orders JOIN part ON p_partkey = o_orderkey % 2000)
SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '( - |,).*$', ''), '^[\\s-]+', ''), '\\s+', ' ', 'g')) AS title, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 50 ORDER BY n DESC, title LIMIT 20""")
def _(spark, sf):
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    t = o.join(p, F.col("o_orderkey") % 2000 == F.col("p_partkey"))
    k, n = F.col("o_orderkey") % 4, F.col("p_name")
    title = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(n, F.lit(" - remote"))).when(k == 2, F.concat(F.lit("- "), n, F.lit(", berlin"))).otherwise(n)
    return mining.suggestions(t.select(title.alias("title")), "title", 50, 20)


@query("ranked_suggestions", """WITH d AS (SELECT p_brand AS k, count(*) AS demand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1)
SELECT s.k, coalesce(demand, 0) AS demand, n FROM s LEFT JOIN d USING (k) WHERE s.k NOT IN ('Brand#1', 'Brand#2')""")
def _(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    d = li.where("l_returnflag = 'R'").join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("k")).agg(F.count(F.lit(1)).alias("demand"))
    s = p.where("p_size > 10").groupBy(F.col("p_brand").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return mining.ranked_suggestions(d, s, "k", p.where("p_brand in ('Brand#1', 'Brand#2')").select(F.col("p_brand").alias("k")))


@query("text_relevance", """SELECT p_partkey, CAST(CASE WHEN list_contains(string_split(lower(p_name), ' '), 'blue') THEN 2.0 WHEN len(list_filter(string_split(lower(p_name), ' '), lambda w: levenshtein(w, 'blue') <= 1)) > 0 THEN 1.0 ELSE 0 END + CASE WHEN list_contains(string_split(lower(p_name), ' '), 'rong') THEN 2.0 WHEN len(list_filter(string_split(lower(p_name), ' '), lambda w: levenshtein(w, 'rong') <= 1)) > 0 THEN 1.0 ELSE 0 END AS DOUBLE) AS score FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", mining.relevance(p, "Blue rong", {"p_name": 2.0}).alias("score"))


@query("demand_pruning", "WITH q AS (SELECT user_id || ' ' || strftime(ts, '%H') AS q, count(*) AS n, max(ts) AS last FROM events GROUP BY 1) SELECT q, n FROM q WHERE NOT (n = 1 AND last < TIMESTAMP '2024-01-15')")
def _(spark, sf):
    q = table(spark, sf, "events").groupBy(F.concat(F.col("user_id").cast("string"), F.lit(" "), F.date_format("ts", "HH")).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return mining.prune_demand(q, "n", "last", F.lit("2024-01-15").cast("timestamp")).select("q", "n")


@query("promoted_domains", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS hits, count(*) FILTER (WHERE l_returnflag <> 'R') AS other FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') >= 180 AND coalesce(count(*) FILTER (WHERE l_returnflag <> 'R') / nullif(count(*), 0), 0) <= 0.67")
def _(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count_if(F.col("l_returnflag") != "R").alias("other"))
    return mining.promoted(c, "hits", "other", 180, 0.67)


@query("title_normalised", """WITH r AS (SELECT p_partkey, '<b>' || upper(p_name) || '</b>  &amp; ' || p_type || CASE p_partkey % 3 WHEN 0 THEN ', Krakow' WHEN 1 THEN ' - Remote' ELSE '' END AS t FROM part), n AS (SELECT p_partkey, trim(regexp_replace(lower(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&amp;', '&')), '\\s+', ' ', 'g')) AS k FROM r)
SELECT p_partkey, regexp_replace(k, '(, krakow| - remote)$', '') AS title, sha256('acme' || chr(30) || k || chr(30) || '') AS fp FROM n""")
def _(spark, sf):
    k = F.col("p_partkey") % 3
    raw = F.concat(F.lit("<b>"), F.upper("p_name"), F.lit("</b>  &amp; "), "p_type", F.when(k == 0, ", Krakow").when(k == 1, " - Remote").otherwise(""))
    t = tx.role_text(raw)
    return table(spark, sf, "part").select("p_partkey", tx.strip_clause(t).alias("title"), tx.fingerprint(F.lit("acme"), t, F.lit(None).cast("string")).alias("fp"))


@query("title_keys", """WITH r AS (SELECT p_partkey, p_name || ' (' || p_type || ')' AS t FROM part) SELECT p_partkey, array_to_string(list_sort([trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g')), trim(regexp_replace(lower(regexp_replace(t, '\\([^)]*\\)', ' ')), '[^\\p{L}\\p{N}]+', ' ', 'g'))]), '|') AS keys, 'acme inc|' || trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS role FROM r""")
def _(spark, sf):
    t = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.title_keys(t), "|").alias("keys"), tx.role_key(F.lit("Acme, (Inc)"), t).alias("role"))


@query("content_hash", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || chr(30) || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, '') || chr(30) || 'a' || chr(31) || 'b' || chr(30)) AS h FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", tx.content_hash(k.cast("string"), F.when(k % 2 == 0, F.col("o_orderstatus")), tx.joined(F.array(F.lit("a"), F.lit("b")))).alias("h"))


@query("url_normalised", """WITH u AS (SELECT page_id, url FROM pages) SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^www\\.', ''), '[?#].*$', ''), '/+$', '') AS job, regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '^www\\.', '') AS domain,
regexp_extract(url, '^([^#]*)', 1) || CASE WHEN contains(regexp_extract(url, '^([^#]*)', 1), '?') THEN '&' ELSE '?' END || 'utm_source=gm' || regexp_extract(url, '(#.*)$', 1) AS tagged FROM u""")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", tx.normalised_job_url(u).alias("job"), tx.domain(u).alias("domain"), tx.tagged_url(u, "gm").alias("tagged"))


@query("url_application", """WITH u AS (SELECT page_id, 'https://Jobs.Example.com/Apply/' || page_id || '/?b=' || page_id % 3 || '&utm_source=x&a=1&b=0&ref=q' AS url FROM pages) SELECT page_id, 'jobs.example.com/Apply/' || page_id || '?a=1&b=' || page_id % 3 || '&b=0' AS url FROM u""")
def _(spark, sf):
    k = F.col("page_id")
    url = F.concat(F.lit("https://Jobs.Example.com/Apply/"), k.cast("string"), F.lit("/?b="), (k % 3).cast("string"), F.lit("&utm_source=x&a=1&b=0&ref=q"))
    return table(spark, sf, "pages").select("page_id", tx.normalised_application_url(url).alias("url"))


@query("stable_split", """SELECT CAST(('0x' || substr(md5('ab:' || CAST(o_custkey AS VARCHAR)), 1, 2))::INTEGER >= 128 AS INTEGER) AS half, ('0x' || substr(md5('holdout:' || CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 10 AS held, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, sf):
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select(sampling.half(k).alias("half"), sampling.holdout(k).alias("held")).groupBy("half", "held").agg(F.count(F.lit(1)).alias("n"))


@query("backoff", "SELECT user_id, CASE WHEN n < 60 THEN 0.0 ELSE least(24.0, 6.0 * power(2.0, least(n - 60, 20))) END AS hours FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", times.backoff_hours(F.col("n"), first=60).alias("hours"))


@query("quiet_hours", "SELECT event_id, extract('hour' FROM ts + INTERVAL 1 HOUR) >= 22 OR extract('hour' FROM ts + INTERVAL 1 HOUR) < 7 AS quiet, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", times.in_quiet_hours(F.col("ts"), F.lit("+01:00"), F.lit(22), F.lit(7)).alias("quiet"), times.iso_week(F.col("ts")).cast("string").alias("week"))


@query("time_crossings", "SELECT o_orderkey FROM orders WHERE (o_orderdate + INTERVAL 15 DAY > TIMESTAMP '1998-05-01' AND o_orderdate + INTERVAL 15 DAY <= TIMESTAMP '1998-05-03') OR (o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1998-05-01' AND o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '1998-05-03')")
def _(spark, sf):
    c = times.crosses(F.col("o_orderdate"), [15, 90], F.lit("1998-05-01").cast("timestamp"), F.lit("1998-05-03").cast("timestamp"))
    return table(spark, sf, "orders").where(c).select("o_orderkey")


@query("timestamps_parsed", """WITH t AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events) SELECT event_id, CASE WHEN event_id % 10 >= 6 THEN NULL WHEN event_id % 10 = 3 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM t""")
def _(spark, sf):
    k, ts = F.col("event_id") % 10, F.date_trunc("second", "ts")
    f = lambda p: F.date_format(ts, p)
    text = (
        F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ssXXX")).when(k == 1, f("yyyy-MM-dd'T'HH:mm:ssXX")).when(k == 2, f("yyyy-MM-dd HH:mm:ss")).when(k == 3, f("yyyy-MM-dd"))
        .when(k == 4, F.unix_seconds(ts).cast("string")).when(k == 5, F.concat(f("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("next week")
    )
    return table(spark, sf, "events").select("event_id", F.date_format(times.parsed(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("listing_fingerprint", "SELECT o_custkey, sha256(string_agg(k || chr(0), '' ORDER BY k)) AS fp FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) GROUP BY o_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    return o.select("o_custkey", tx.listing_fingerprint(F.col("ids")).alias("fp"))


#: Sentences with the level, the years and the intermediary that they state.
STATED = (
    ("PhD or Master's needed", "phd", None, None), ("3 to 5 years of Java", None, 3, None), ("no experience required", None, 0, None), ("25 years old; 2+ yrs", None, 2, None),
    ("no degree required", "none", None, None), ("our client is seeking 10 years", None, 10, True), ("we listen to our client", None, None, None), ("30 years in trade, graduate degree", "master", 30, None),
    ("No experience is required with Go, 60 years", None, None, None), ("doctoral student, 4-yr plan", "phd", None, None), ("Work without a degree on behalf of our valued client", "none", None, True),
    ("Needs: 7 years\nNice to have:\n1 year of Rust, PhD\nOffer:\nmoney", None, 7, None), ("bachelor’s or equivalent; no degree required", "bachelor", None, None),
)


def _cases(i: int) -> str:
    show = lambda v: "NULL" if v is None else repr(v)
    return " ".join(f"WHEN {k} THEN {show(row[i])}" for k, row in enumerate(STATED))


@query("education_experience", f"SELECT doc_id, CASE doc_id % {len(STATED)} {_cases(1)} END AS level, CAST(CASE doc_id % {len(STATED)} {_cases(2)} END AS INTEGER) AS years, CAST(CASE doc_id % {len(STATED)} {_cases(3)} END AS BOOLEAN) AS recruiter FROM documents")
def _(spark, sf):
    t = F.element_at(F.array(*(F.lit(row[0]) for row in STATED)), (F.col("doc_id") % len(STATED) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", tx.education_level(t).alias("level"), tx.experience_years(t).alias("years"), tx.via_recruiter(t).alias("recruiter"))


@query("slugs", "SELECT p_partkey, regexp_replace(lower(p_name || ' Ü' || p_brand), '[^a-zü0-9]+', '-', 'g') AS raw, regexp_replace(regexp_replace(replace(lower(p_name || ' Ü' || p_brand), 'ü', 'u'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, substr(sha256('src' || chr(0) || CAST(p_partkey AS VARCHAR)), 1, 13) AS code FROM part")
def _(spark, sf):
    name, key = F.concat("p_name", F.lit(" Ü"), "p_brand"), F.col("p_partkey").cast("string")
    full = tx.job_slug(name, F.lit("co"), F.lit("src"), key)
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.lower(name), "[^a-zü0-9]+", "-").alias("raw"), tx.slug(name).alias("slug"), tx.code_of_slug(full).alias("code"))


@query("country_metro", f"""WITH {WITH_COUNTRY} SELECT CASE n_name WHEN 'NATION_1' THEN 'Metro A' WHEN 'NATION_2' THEN 'Metro B' END AS metro, count(*) AS n FROM pc WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1""")
def _(spark, sf):
    """Ambiguous places (two metros) resolve to none."""
    from gristmill.operators.joins import unique_claims

    metros = spark.createDataFrame([("NATION_1", "Metro A"), ("NATION_2", "Metro B"), ("NATION_3", "Metro C"), ("NATION_3", "Metro D")], "n_name string, metro string")
    rows = with_country(spark, sf).where("n_name in ('NATION_1', 'NATION_2', 'NATION_3')")
    return rows.join(F.broadcast(unique_claims(metros, "n_name", "metro")), "n_name", "left").groupBy("metro").agg(F.count(F.lit(1)).alias("n"))
