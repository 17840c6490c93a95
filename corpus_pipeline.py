"""The corpus pipeline: documents in, token ids out, by five operators in turn.

Each stage works on all rows that the one before kept.  A stage's result is
written as Parquet in the shared folder and read again, so an executor that is
lost costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, decontam, minhash, pii, toxicity
from gristmill.llm.common import cut, prepare, row_id, spread
from gristmill.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5; null and empty texts stay.  The lexicon is learned from table labels."""
    prepare(spark)
    lexicon = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(spread(docs.select(*COLUMNS)), lexicon, out="_toxic").where(F.col("_toxic") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group of near duplicates.

    Texts without words are in no group and stay; equal rows are one, and rows
    that repeat a doc_id with another text are compared by their own text; rows
    without a doc_id stay.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    rows = docs.where("doc_id is not null").withColumn("_rid", row_id())
    groups = cut(minhash.grouped(rows), "groups")
    # Of a group the row of the least id; of rows of that id, the one of the least hash.
    first = groups.where("component is not null and doc_id = component_id").groupBy("component").agg(F.min("rid").alias("rid"))
    gone = cut(groups.where("component is not null").join(first.select("rid"), "rid", "left_anti").select(F.col("rid").alias("_rid")).distinct(), "gone")
    # Only equal rows are brought together: the others' texts need not move.
    again = cut(groups.groupBy(F.col("rid").alias("_rid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_rid"), "again")
    left = rows.join(gone, "_rid", "left_anti")
    kept = left.join(again, "_rid", "left_anti").select(*COLUMNS).unionByName(left.join(again, "_rid", "left_semi").dropDuplicates(["_rid"]).select(*COLUMNS))
    return kept.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of table benchmark."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets; n_chars counts the new text."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    return pii.masked(docs, pii.spans(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of ids and decoded text."""
    prepare(spark)
    out = bpe.round_trip(spread(docs.select("doc_id", "lang", "source", "text")), vocabulary())
    return out.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", tokenize),
]

#: SQL has no operation for the learned lexicon, MinHash, the graph of patterns or the tokenizer's automaton: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
