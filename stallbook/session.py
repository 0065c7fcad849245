"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # dedupe state lives off the heap, so it may outgrow executor memory
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

_local_folders: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(
    cores: int | str = "*", partitions: int = 8, memory: str = "8g", **settings: str
) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stallbook")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    without it is refused, because a machine-local folder would be lost with
    its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="stallbook-")
        context.setCheckpointDir(os.path.join(_local_folders[app], "rdd"))
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is neither installed nor on
    their path: Spark hands them a zip of it, once per application."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    on_path = str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    installed = package.parent.name in ("site-packages", "dist-packages")
    if on_path or installed or context.applicationId in _shipped:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="package-"), package.name)
    context.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))
    _shipped.add(context.applicationId)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote to the shared folder, once no frame
    that reads it is needed any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within are deleted as each statement ends, not when
    the driver happens to drop its frames.  For statements whose result is written:
    what is read again is the written table."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several later steps read the same shuffled result: the lineage
    is cut by files that outlive any executor, each reader still prunes columns
    and pushes filters, and Spark knows the size when it plans a join with the
    result.  The files stay until :func:`clear_scratch`.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
