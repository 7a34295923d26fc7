"""Cutting lineage through tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local`` master, where driver and executors are one process, gets a
    temporary folder when the setting is absent.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/pathloom/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


# Files of a finished write's shuffles go at once instead of with the session.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# A task of a written stage reads no more shuffled bytes than this. They are compressed: rows of ids and short
# strings take up to ten times as much where a task sorts or hashes them.
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
MOST_ADVISED = 16 << 20


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def materialize(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet and return a reader of the written table.

    Unlike a cached DataFrame the result survives the loss of any executor, and
    unlike a recomputed one it is numbered identically by every consumer. With
    ``partition_by`` the rows of a folder are gathered first, large folders
    being split by the optimiser, so that no task writes a file per folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    settings = {_CLEAN_UP: "true"}
    if _bytes(spark, spark.conf.get(_ADVISED)) > MOST_ADVISED:
        settings[_ADVISED] = str(MOST_ADVISED)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        writer.parquet(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> None:
    """Delete every table this session has materialized; call it when no reader is left."""
    folder = shared_folder(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
