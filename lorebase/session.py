"""Session helpers: settings for local runs, shipping the package, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "lorebase") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application, for the Arrow functions."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lorebase-"), "lorebase_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE_DIR):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE_DIR)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder the cluster names.

    The folder is read from ``spark.checkpoint.dir``. Only where that is unset, as in
    a bare local test, a folder of our own is used.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the application, set if it is not yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorebase-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder and read again.

    For wide tables that several later steps read in part: other than a checkpoint, it is
    read by column and with pushed filters. The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder, for a table or store that a query builds; it goes when the application ends."""
    path = f"{_shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which the session broadcasts; -1 for never."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def broadcast_measured(small: DataFrame, row_bytes: int) -> DataFrame:
    """A computed table, as a broadcast side if its rows, counted, stay within the session's limit.

    ``row_bytes`` is an upper estimate of one row. Beyond the limit the join shuffles.
    """
    return F.broadcast(small) if small.count() * row_bytes <= broadcast_limit(small.sparkSession) else small
