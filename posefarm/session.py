"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on.  A skewed join must be split even
# when the split costs one more exchange before the aggregate that follows it.
_RUNTIME = {
    # Chains of arithmetic columns make inferred constraints grow without bound.
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # A hot complex spreads over all keys of a join; views of small complexes switch this off.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # A few kilobytes of atoms grow to millions of cells: small shuffles keep their
    # parallelism.  Above default parallelism times this size it has no effect.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # A task sorts and aggregates what it reads several times over, so its share is kept small.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}

#: Rows of a large table that a partition of its shuffles starts from.
ROWS_PER_TASK = 500_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def spread(spark: SparkSession, rows: int) -> None:
    """Let shuffles start from as many partitions as a table of that many rows needs for the share
    of a task to stay the same at any size; adaptive execution joins those that turn out small."""
    known = spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(_INITIAL, str(max(int(known), -(-rows // ROWS_PER_TASK))))


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("posefarm")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only where none is set."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="posefarm-checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name next to the checkpoints, on whatever file system holds them."""
    return f"{checkpoint_dir(spark).rstrip('/')}/posefarm-{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`shared_folder`, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query are deleted when the query ends, not when the
    driver happens to collect its garbage.  For writes: a frame that is read again is shuffled again."""
    known = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if known is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, known)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, wherever they run; Spark's own file server
    delivers it, the driver alone reads the archive."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="posefarm-"), "posefarm.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame by writing it to the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
