"""Sessions and the folder for cut lineages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_shipped: set[str] = set()


def build(app: str = "shelfmark", **conf: str) -> SparkSession:
    """A session with the settings this library is tested with; UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a local master may leave it out: it then gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="shelfmark-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def saver(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a DataFrame below the shared folder and reads it back, so that its lineage ends there."""
    base = shared_folder(spark)

    def save(df: DataFrame) -> DataFrame:
        path = f"{base}/cut-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def spread(df: DataFrame, each: int = 4) -> DataFrame:
    """A scan in ``each`` partitions a core or more, for work that is long for each row: rows that compress well lie in so
    few splits of a file that one task would have most of them."""
    n = each * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python tasks can import it."""
    key = spark.sparkContext.applicationId
    if key not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        into = tempfile.mkdtemp(prefix="shelfmark-ship-")
        atexit.register(shutil.rmtree, into, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/shelfmark", "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(key)
