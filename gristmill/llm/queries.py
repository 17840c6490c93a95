"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, chat, decontam, minhash, pages, pii, quality, secrets, topk, toxicity
from gristmill.llm.common import documents, shipped, spread

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), path="source")
    return found.withColumn("secret_sha256", F.sha2(F.col("secret").cast("binary"), 256)).drop("secret")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(documents(spark, sf_dir), labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return pages.main_text(spread(rows)).withColumn("n_chars", F.length("text").cast("long"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spread(documents(spark, sf_dir).select("doc_id", "text")), vocabulary())


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Query] = {f.__name__: shipped(f) for f in (op1_topk, op2_minhash, op3_toxicity, op4_secrets, op5_quality, op6_pii, op7_main_text, op8_decontam, op9_bpe, op10_chat)}

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
k AS (SELECT list_sort(s) AS s, row_number() OVER () AS c, min(doc_id) AS f, len(any_value(s)) AS n FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY list_sort(s)),
x AS (SELECT c, n, unnest(s) AS g FROM k),
i AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c),
l AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * (na + nb - shared) UNION SELECT b, a FROM i WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT c AS u, c AS v FROM k UNION SELECT r.u, l.b FROM r JOIN l ON r.v = l.a),
m AS (SELECT r.u AS c, min(k.f) AS component FROM r JOIN k ON k.c = r.v GROUP BY r.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(s.doc_id = coalesce(m.component, s.doc_id), false) AS kept
FROM s LEFT JOIN k ON list_sort(s.s) = k.s LEFT JOIN m ON m.c = k.c
"""

ORACLE: dict[str, str] = {"op1_topk": TOPK_SQL, "op2_minhash": MINHASH_SQL, "op8_decontam": decontam.ORACLE, "op10_chat": chat.ORACLE}
