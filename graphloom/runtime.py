"""Session helpers: the shared scratch folder, tables written there, and worker import paths."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of an Arrow batch between Spark and its Python workers: long texts would make batches of the default rows huge.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them, and bound their batches.

    On a cluster ship the package with ``--py-files``; the path added here only
    helps where workers see the driver's checkout. The session's batches are
    held to ``BATCH_BYTES`` unless it asks for less.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master, where driver and tasks are one machine, a temporary
    folder stands in for a missing setting; elsewhere that is an error, since
    each executor would write to a disk of its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        given = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


#: Scratch roots that this driver has made and not cleaned.
_roots: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    root = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    _roots.append(root)
    return f"{root}/{name}"


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Within, queries may leave tables in the shared folder; at the end those made within are deleted.

    Write or collect results before the end: DataFrames that still read such a
    table fail afterwards. Jobs may be nested; tables made outside stay. One
    job at a time for each driver: threads that run side by side share the list.
    """
    first = len(_roots)
    try:
        yield
    finally:
        for root in _roots[first:]:
            remove(spark, root)
        del _roots[first:]


@contextmanager
def _tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _tidy_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return _write(df, scratch(df.sparkSession, name))


class Tables:
    """Scratch tables of one job by name, each written to the shared folder and read back.

    Writing under a name again deletes the table that had it, once the new one
    is there, so a loop may read its last round. What a returned DataFrame still
    reads must not be dropped.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.root = spark, scratch(spark, job)
        self.paths: dict[str, str] = {}
        self.written = 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        out = _write(df, path)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
