"""Spark session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "codecairn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; existing settings win on a cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return attach(builder.getOrCreate())


_attached: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers of a session (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId not in _attached:
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="codecairn-ship-")) / "codecairn_pkg.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, str(source.relative_to(root.parent)))
        sc.addPyFile(str(archive))
        _attached.add(sc.applicationId)
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Used where a later step must see exactly the same rows in the same
    partitions (range blocks), or where generated text must not be produced
    twice.  The folder is the one the cluster names in
    ``spark.checkpoint.dir``; a local master without that setting gets a
    scratch folder, any other master without it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="codecairn-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, below ``spark.checkpoint.dir``.

    A local master without that setting gets a scratch folder, any other master
    without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="codecairn-shared-")
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    """Number of range blocks to cut an ordered fold into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and meets the other by key.

    Rows made out of a scan or a checkpoint are counted by the planner with the
    compressed bytes of the file they came from, a hundredth of their size, so
    that a whole table would pass through the driver as a broadcast.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan at least one partition per core before costly row work.

    A table in a single row group is one task however long its rows take.  A
    scan that already has enough partitions is returned as it is, so nothing
    large is shuffled.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= width else df.repartition(width)
