"""Sinks that readers never see half written.

A version is a folder of its own; a small numbered pointer file, written last,
names the current one.  All file access goes through Hadoop's file systems, so paths can be
in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, there whole or not at all: written beside its place and renamed.  A file that is there already is an error."""
    fs, p = _fs(spark, path)
    folder, name = path.rsplit("/", 1)
    _, tmp = _fs(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(tmp, p):
        fs.delete(tmp, False)
        raise FileExistsError(path)


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of the pointer files, newest last."""
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith("current-") and n.endswith(".json"))


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write df as a new version below path and make it the current one; versions beyond `keep` are deleted.

    Pointers are numbered and the newest counts, so there is always one to read;
    of two that publish at once one fails.
    """
    spark = df.sparkSession
    pointers = _pointers(spark, path)
    before = json.loads(read_text(spark, f"{path}/{pointers[-1]}"))["versions"] if pointers else []
    number = int(pointers[-1][8:-5]) + 1 if pointers else 0
    version = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    versions = [*before, version]
    _write_text(spark, f"{path}/current-{number:08d}.json", json.dumps({"current": version, "versions": versions[-keep:]}))
    for old in [*versions[:-keep], *pointers[:-1]]:
        fs, p = _fs(spark, f"{path}/{old}")
        fs.delete(p, True)
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; a pointer that is removed while it is looked at is looked for again."""
    for _ in range(5):
        pointers = _pointers(spark, path)
        found = read_text(spark, f"{path}/{pointers[-1]}") if pointers else None
        if found is not None:
            return spark.read.parquet(f"{path}/{json.loads(found)['current']}")
        if not pointers:
            break
    raise FileNotFoundError(f"nothing is published at {path}")


def export_day(df: DataFrame, path: str, day: str, key: str) -> dict:
    """Gzip JSON lines and a manifest (rows, digest), written last; a published day is never written again."""
    spark = df.sparkSession
    folder = f"{path}/{day}"
    if read_text(spark, f"{folder}/manifest.json") is not None:
        raise FileExistsError(f"{day} is published")
    df.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/data")
    back = spark.read.schema(df.schema).json(f"{folder}/data")
    seen = back.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"), F.max(key).cast("string").alias("last")).first()
    manifest = {"day": day, "rows": seen["rows"], "digest": seen["digest"], "last": seen["last"]}
    _write_text(spark, f"{folder}/manifest.json", json.dumps(manifest))
    return manifest


def published_days(spark: SparkSession, path: str, keep: int | None = None) -> list[str]:
    """Days with a manifest, newest last; with keep, older ones are deleted first."""
    fs, p = _fs(spark, path)
    days = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []
    days = [d for d in days if read_text(spark, f"{path}/{d}/manifest.json") is not None]
    if keep is not None:
        for d in days[:-keep]:
            fs.delete(_fs(spark, f"{path}/{d}")[1], True)
        days = days[-keep:]
    return days
