"""Session settings and shared scratch space."""
from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
# scratch folders made for sessions that name none, by application
_OWN: dict[str, str] = {}
# scratch paths handed out, by application
_WRITTEN: dict[str, list[str]] = {}
# applications whose workers have the package
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of the application, once.

    A driver that runs from a source folder has it on its own path only; on a
    cluster where the package is installed this does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="strainlens-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    # the driver's own temporary folder: Spark copies the archive to the workers
    context.addPyFile(shutil.make_archive(os.path.join(folder, "strainlens"), "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the workers before it is built."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors for hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    may do without: it gets a temporary folder of its own, which goes with it.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="strainlens-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
    return _OWN[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is written to scratch paths inside.

    Results are lazy and read those tables, so read or write a result before
    the block ends.
    """
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(written) > before:
            path = jvm.org.apache.hadoop.fs.Path(written.pop())
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def open_files(spark: SparkSession, files: int = 256) -> Iterator[None]:
    """Writes inside keep up to ``files`` output files of a task open.

    A partitioned write otherwise sorts all rows of a task by their folder.
    Spark sorts what is left where a task meets more folders than that.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(files))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@contextmanager
def arrow_batches(spark: SparkSession, records: int) -> Iterator[None]:
    """Queries that run inside hand at most ``records`` rows at once to Python.

    For rows that grow there.  A result is lazy, so write it before the block
    ends.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(records, before) if before > 0 else records))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors and bounds the plan of
    iterative jobs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
