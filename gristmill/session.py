"""Session defaults, the shared scratch folder, and sending the package to executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects on a cluster as well."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gristmill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a folder of its
    own is made, and set as the checkpoint folder too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, folder, True)
        _LOCAL[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a session, so that they need no installation of it.

    The archive lies in the shared folder, where a new executor finds it too.
    """
    sc = spark.sparkContext
    top = os.path.dirname(os.path.abspath(__file__))
    if _SHIPPED.get("app") == sc.applicationId or not os.path.isdir(top):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for at, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    target = f"{scratch_dir(spark)}/gristmill/src-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED["app"] = sc.applicationId
