"""Session factory and the shared-folder helper every iterative operator uses."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "kestrel", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("KESTREL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Spark's setting to delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session (driver and executors on one machine) may fall back to a temporary folder; elsewhere
    a missing setting is an error, because executors would write to disks that the others cannot see.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames that are made and run inside go with each run's end."""
    held = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


_collected = 0.0


def hand_back(spark: SparkSession, every_s: float = 3.0) -> None:
    """Let the driver give back the heap that finished plans, broadcasts and their status took, once it holds over half of what it may:
    a collector left alone grows the heap to its limit before it looks, and queries of many short rounds leave little that lives."""
    global _collected
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() * 2 > heap.maxMemory() and time.monotonic() - _collected > every_s:
        jvm.java.lang.System.gc()
        _collected = time.monotonic()


def materialise(df: DataFrame, schema: StructType | None = None, group_mb: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, columns stay prunable, and a lost
    executor costs nothing that has to be recomputed. Shuffle files of the write go with its end: the table stands for them. ``schema`` names
    what its columns are read back as, where stored values stand for others (vectors). ``group_mb`` bounds what is read at once where rows
    are long: a reader takes thousands of rows together, but none from beyond a group's end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    groups = {"parquet.block.size": str(group_mb << 20), "parquet.page.size.row.check.min": "8"} if group_mb else {}
    with tidied(spark):
        df.write.option("compression", "zstd").options(**groups).parquet(path)
    hand_back(spark)
    return spark.read.schema(schema or df.schema).parquet(path)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    own = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if own not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (own, held)))
