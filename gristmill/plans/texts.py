"""Queries: text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import arrow
from gristmill.functions import text as tx
from gristmill.plans.registry import query
from gristmill.session import ship
from gristmill.sources import logs
from gristmill.sources.tables import table


@query("text_signature", """SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: len(w) > 3))) AS n FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.signature(F.col("text"))).cast("long").alias("n"))


@query("text_plain", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.plain_text(F.col("html")).alias("text"))


@query("text_shapes", """WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' C++ !' WHEN 1 THEN ' node_js.' ELSE ' a-b' END AS t FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}+#]+$', ''), '[-_ ]+', ' ', 'g')) AS phrase, upper(substr(split_part(t, ' ', 1), 1, 1)) || substr(split_part(t, ' ', 1), 2) AS first, length(t) <= 60 AND len(string_split(t, ' ')) <= 8 AS recordable, 'title_' || sha256(t) AS document FROM t""")
def _(spark, sf):
    k = F.col("p_partkey") % 3
    t = F.concat("p_name", F.when(k == 0, " C++ !").when(k == 1, " node_js.").otherwise(" a-b"))
    return table(spark, sf, "part").select("p_partkey", tx.skill_phrase(t).alias("phrase"), F.split_part(tx.capitalise(t), F.lit(" "), F.lit(1)).alias("first"), tx.recordable(t).alias("recordable"), tx.document_id("title", t).alias("document"))


@query("text_words", """SELECT p_partkey, regexp_matches(lower(p_name), '(^|[^\\p{L}\\p{N}])blue($|[^\\p{L}\\p{N}])') AS blue, p_name NOT IN ('small ring') AND (regexp_matches(p_name, 'ring') OR regexp_matches(p_name, 'bolt')) AS marked FROM part""")
def _(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", tx.has_word(n, "Blue").alias("blue"), ((n != "small ring") & tx.has_any(n, ["ring", "bolt"])).alias("marked"))


@query("text_aliases", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'aws,kubernetes' WHEN 1 THEN 'kubernetes' ELSE '' END AS names, CASE WHEN p_partkey % 2 = 0 THEN 'eu' ELSE 'eu,global' END AS regions FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    values = F.when(k % 3 == 0, F.array(F.lit(" K8s "), F.lit("AWS"), F.lit("amazon web services"))).when(k % 3 == 1, F.array(F.lit("k8s"), F.lit("cobol"))).otherwise(F.array().cast("array<string>"))
    names = tx.canonicalised(values, {"k8s": "kubernetes", "aws": "aws", "amazon web services": "aws"})
    regions = tx.unshadowed(F.array(F.lit("eu"), F.lit("global")), F.when(k % 2 == 0, "Berlin").otherwise("Berlin or anywhere"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(names, ",").alias("names"), F.array_join(regions, ",").alias("regions"))


@query("text_clean", """SELECT p_partkey, p_name || ' x' AS title, p_type AS place, p_brand || ':' || p_partkey AS space, replace(replace(p_name, ' ', '_'), '_', '\\_') || '%' AS prefix FROM part""")
def _(spark, sf):
    title = F.concat(F.lit("﻿"), "p_name", F.lit("​x­"))
    place = F.concat(F.lit("Location: "), "p_type", F.lit(", (52.5200, 13.4050)"))
    return table(spark, sf, "part").select("p_partkey", tx.clean_title(title).alias("title"), tx.clean_location(place).alias("place"), tx.namespaced(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("space"), tx.like_prefix(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("prefix"))


@query("text_salary", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 THEN CAST(round(l_quantity * 1.5 - 7) AS BIGINT) END AS bound, CAST(round(l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 100000 ELSE 10000000 END) AS BIGINT) AS inr FROM lineitem WHERE l_quantity <> 5""".replace("CASE WHEN l_quantity > 5 THEN CAST(round(l_quantity * 1.5 - 7) AS BIGINT) END", "CASE WHEN round(l_quantity * 1.5 - 7) > 0 THEN CAST(round(l_quantity * 1.5 - 7) AS BIGINT) END"))
def _(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity <> 5")
    text = (F.col("l_quantity") * 1.5 - 7).cast("string")
    label = F.concat(F.lit("INR "), F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " Lakh p.a.").otherwise(" crore"))
    return li.select("l_orderkey", "l_linenumber", tx.bound(text).alias("bound"), tx.lakh(label).alias("inr"))


@query("json_lenient", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' ELSE 'x' END AS names, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS n, event_id % 4 IN (0, 1) AS yes, event_id % 100 AS k FROM events""")
def _(spark, sf):
    k = F.col("event_id")
    num = (k % 100).cast("string")
    names = F.when(k % 4 == 0, F.lit('["a","b"]')).when(k % 4 == 1, F.lit('"x"')).otherwise("x")
    n = F.when(k % 4 == 3, F.lit('"many"')).when(k % 2 == 0, num).otherwise(F.concat(F.lit('"'), num, F.lit('"')))
    yes = F.when(k % 4 == 0, "true").when(k % 4 == 1, '"Yes"').when(k % 4 == 2, "0").otherwise(F.lit(None).cast("string"))
    raw = F.concat(F.lit('{"a":\n"b\t", "k": '), num, F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.array_join(tx.strings(names), ",").alias("names"), tx.number(n).alias("n"), tx.truthy(yes).alias("yes"), F.get_json_object(tx.repaired_json(raw), "$.k").cast("long").alias("k"))


@query("split_with_ordinality", "SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, part FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part, generate_subscripts(string_split(o_orderpriority, '-'), 1) - 1 AS pos FROM orders)")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.posexplode(F.split("o_orderpriority", "-")).alias("pos", "part"))


@query("text_encoded", "SELECT p_partkey, replace(replace(p_name || ' &ü', ' ', '+'), '&ü', '%26%C3%BC') AS encoded, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS query FROM part")
def _(spark, sf):
    quoted = F.concat(F.lit('"'), "p_name", F.lit('"'))
    return table(spark, sf, "part").select("p_partkey", F.url_encode(F.concat("p_name", F.lit(" &ü"))).alias("encoded"), tx.literal_query(quoted).alias("query"))


@query("text_entities")
def _(spark, sf):
    """Whole pages with their references decoded, and whole texts in ASCII; no SQL has either, tests compare with Python."""
    ship(spark)
    t, d = table(spark, sf, "pages"), table(spark, sf, "documents")
    md5 = lambda c: F.md5(c.cast("binary"))
    pages = t.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), arrow.entities(F.col("html")).alias("t"))
    texts = d.select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), arrow.transliterated(F.col("text")).alias("t"))
    return pages.unionByName(texts).select("kind", "id", F.length("t").alias("n_chars"), md5(F.col("t")).alias("md5"))


@query("text_chunks")
def _(spark, sf):
    ship(spark)
    c = table(spark, sf, "documents").select("doc_id", F.posexplode(arrow.chunks(F.col("text"), 2000)).alias("chunk", "piece"))
    return c.select("doc_id", "chunk", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("md5"))


@query("text_language")
def _(spark, sf):
    ship(spark)
    d = table(spark, sf, "documents").select("lang", arrow.language(F.col("text")).alias("guess"))
    return d.groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))


@query("text_optional_masked", "SELECT doc_id, sha256('Must:' || chr(10) || 'SQL' || chr(10) || repeat(' ', 12) || chr(10) || repeat(' ', 5) || chr(10) || 'Benefits:' || chr(10) || text) AS sha256, CAST(39 + length(text) AS BIGINT) AS n FROM documents")
def _(spark, sf):
    """Whole texts with sections in front, of which one is optional."""
    ship(spark)
    m = arrow.without_optional(F.concat(F.lit("Must:\nSQL\nNice to have\nScala\nBenefits:\n"), "text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(m.cast("binary"), 256).alias("sha256"), F.length(m).cast("long").alias("n"))


@query("list_records", "SELECT DISTINCT p_brand AS name, replace(lower(p_brand), '#', '-') AS slug FROM part")
def _(spark, sf):
    rows = table(spark, sf, "part").select("p_brand").distinct()
    cells = rows.select(F.concat(F.lit("<table><tr><td><b>"), "p_brand", F.lit("</b></td><td>x</td></tr></table>")).alias("value"))
    return logs.list_records(cells, "table")


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, CAST(0 AS BIGINT) AS postings FROM pages")
def _(spark, sf):
    p = arrow.json_ld(table(spark, sf, "pages"))
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.size("postings").cast("long").alias("postings"))


@query("cv_score", "SELECT p_partkey, round((least(p_size / 50.0, 1) * 3 + least(p_retailprice / 2000, 1) * 1) / 4 * 100, 8) AS score, CAST(p_size / 50.0 >= 0.8 AS INTEGER) + CAST(p_retailprice / 2000 >= 0.8 AS INTEGER) AS passed FROM part")
def _(spark, sf):
    from gristmill.operators.match import category_score

    one = lambda c: F.least(c, F.lit(1.0))
    s = category_score({"size": (one(F.col("p_size") / 50.0), 3.0), "price": (one(F.col("p_retailprice") / 2000), 1.0)})
    return table(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.score", "s.passed")


@query("publish_roundtrip", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    """Published as a new version, and read back through the pointer."""
    from gristmill.plans.streams import _scratch
    from gristmill.sources import publish

    path = _scratch(spark)
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    publish.publish(e.where("n < 0"), path)
    publish.publish(e, path)
    return publish.current(spark, path)


@query("export_day", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def _(spark, sf):
    """Gzip JSON lines with a manifest, read back."""
    from gristmill.plans.streams import _scratch
    from gristmill.sources import publish

    path = _scratch(spark)
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    publish.export_day(e, path, "2024-01-30", "user_id")
    return spark.read.schema(e.schema).json(f"{path}/2024-01-30/data")


@query("url_provider", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'lever' WHEN 1 THEN 'personio' END AS provider, CASE page_id % 4 WHEN 0 THEN 'acme' || page_id WHEN 1 THEN 'co' || page_id END AS board, CASE WHEN page_id % 3 = 0 THEN 'acme' || page_id || '.example' END AS host FROM pages""")
def _(spark, sf):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://jobs.lever.co/Acme"), n, F.lit("/1?x=2"))).when(k == 1, F.concat(F.lit("https://co"), n, F.lit(".jobs.personio.de/job/7"))).when(k == 2, "https://jobs.lever.co/").otherwise(F.col("url"))
    info = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"website": " https://www.Acme'), n, F.lit('.example/about "}'))).otherwise("{}")
    p = tx.provider(url)
    return table(spark, sf, "pages").select("page_id", p.getField("provider").alias("provider"), p.getField("board").alias("board"), tx.site_host(info).alias("host"))


@query("digest_due", """SELECT event_id, extract('hour' FROM ts + INTERVAL 2 HOUR) >= 9 AND (event_id % 3 = 0 OR CAST(ts - to_hours(CAST(event_id % 30 AS INTEGER)) + INTERVAL 2 HOUR AS DATE) < CAST(ts + INTERVAL 2 HOUR AS DATE)) AS due FROM events""")
def _(spark, sf):
    from gristmill.functions.times import digest_due

    k = F.col("event_id")
    last = F.when(k % 3 != 0, F.timestamp_add("HOUR", (-(k % 30)).cast("int"), F.col("ts")))
    return table(spark, sf, "events").select("event_id", digest_due(F.col("ts"), F.lit("+02:00"), F.lit(9), last).alias("due"))


@query("match_bound", "SELECT p_size AS n, round(ceil(60 * p_size / 100.0) / (sqrt(5) * sqrt(p_size + power(4 * greatest(p_size, 6), 2))), 9) AS least FROM (SELECT DISTINCT p_size FROM part)")
def _(spark, sf):
    from gristmill.operators.match import min_cosine

    return table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct().select("n", F.round(min_cosine(F.lit(60), F.col("n"), F.lit(5)), 9).alias("least"))


@query("salary_lateral", "SELECT l_orderkey, l_linenumber, tier FROM lineitem, LATERAL (SELECT CASE WHEN l_quantity > 40 THEN 'a' WHEN l_quantity > 20 THEN 'b' ELSE 'c' END AS tier)")
def _(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("gm_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, tier FROM gm_lineitem, LATERAL (SELECT CASE WHEN l_quantity > 40 THEN 'a' WHEN l_quantity > 20 THEN 'b' ELSE 'c' END AS tier)")


@query("term_folds", """WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' & Ёлка' WHEN 1 THEN '-' || p_type WHEN 2 THEN '__' || p_brand ELSE repeat(' long word', 12) END AS t FROM part),
f AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(lower(t), 'ё', 'е'), '&', ' and '), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM t) SELECT p_partkey, CASE WHEN length(f) BETWEEN 1 AND 80 THEN f END AS term FROM f""")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    t = F.concat("p_name", F.when(k == 0, F.lit(" & Ёлка")).when(k == 1, F.concat(F.lit("-"), "p_type")).when(k == 2, F.concat(F.lit("__"), "p_brand")).otherwise(F.repeat(F.lit(" long word"), F.lit(12))))
    return table(spark, sf, "part").select("p_partkey", tx.fold_term(t).alias("term"))


@query("token_jaccard", """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, CASE WHEN p_partkey % 5 = 0 THEN [] ELSE list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) END AS b FROM part)
SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS similarity, NOT (len(list_filter(a, lambda w: w NOT IN ('blue', 'rong', 'the'))) = 0) AS offered FROM t""")
def _(spark, sf):
    a = F.array_distinct(F.split(F.lower("p_name"), " "))
    b = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")))
    return table(spark, sf, "part").select("p_partkey", F.round(tx.jaccard(a, b), 9).alias("similarity"), tx.offerable(F.lower("p_name"), ["blue", "rong", "the"]).alias("offered"))
