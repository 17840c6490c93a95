"""Loading of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table; zone-less timestamps become UTC timestamps.

    The cast is a plain projection, so filters on other columns and column
    pruning still reach the Parquet scan.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
