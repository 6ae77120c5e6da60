"""Session helpers: local sessions for tests and benches, and the checkpoint folder rule."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "riskpanel", **conf) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session and settings."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "32m",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only where the session has none.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder, because there the driver's disk
    is the shared disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="riskpanel-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # on a cluster the shared folder's owner cleans up
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where two consumers must see the same physical partitions or where an
    iterative plan would grow; a lost executor then re-reads files instead of
    recomputing the history.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Spark removes the shuffle files of a query when it ends, not when the driver's memory is next collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs within the block free their shuffles when they end."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


# Input files' bytes for each partition of a shuffle, and shuffled bytes that a task reads at most where Spark joins partitions.
PARTITION_INPUT = 8 << 20
PARTITION_READ = 16 << 20
_PARTITIONS = "spark.sql.shuffle.partitions"
_READ = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bytes_of(size: str) -> int:
    """Bytes of a setting such as ``64MB``, ``8m`` or ``1024``."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * (" kmgt".index(unit) if unit else 0)


def input_bytes(*frames: DataFrame) -> int:
    """Size of the files that the frames read."""
    total = 0
    for name in {name for df in frames for name in df.inputFiles()}:
        spark = frames[0].sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


@contextmanager
def sized_shuffles(*frames: DataFrame) -> Iterator[None]:
    """Jobs within the block shuffle to partitions whose number grows with the frames' files, so that a task's share does not."""
    conf = frames[0].sparkSession.conf
    before = {key: conf.get(key, None) for key in (_PARTITIONS, _READ)}
    conf.set(_PARTITIONS, str(max(int(conf.get(_PARTITIONS)), -(-input_bytes(*frames) // PARTITION_INPUT))))
    conf.set(_READ, str(min(_bytes_of(conf.get(_READ)), PARTITION_READ)))
    try:
        yield
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def cut_to_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and continue from the table.

    Like ``cut_lineage``, but columnar: smaller for long tables, and a reader of
    few columns reads only those. The shuffles behind the table are freed once it
    is written.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_to_table`` wrote, after its last reader."""
    spark = df.sparkSession
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        if os.path.basename(folder).startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_parallel(job: Callable, items: Sequence, parallelism: int) -> list:
    """Submit independent Spark jobs from a few driver threads, results in order."""
    if parallelism <= 1 or len(items) <= 1:
        return [job(item) for item in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(job, items, chunksize=1)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per application, and small batches.

    The package is needed where it is on the driver's path only; Spark's own
    file distribution carries the archive. Batches of long texts are held
    several times over by a worker and its executor, so they are kept to a few
    megabytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="riskpanel-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root, name = os.path.split(package)
    context.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))
    _shipped.add(context.applicationId)
