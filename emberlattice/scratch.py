"""Tables in the folder that driver and executors share: where plans are cut and lost executors start again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write are of no more use: the written table stands for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: Folders of local sessions that name none, by application.
OWN: dict[str, str] = {}
#: Jobs' folders that go when the interim that is open ends.
INTERIM: ContextVar[list[str] | None] = ContextVar("interim", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the master is local, a temporary one of the application, which goes
    when Python ends. (The setting itself can't be changed once a session runs.)"""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in OWN:
        OWN[app] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, OWN[app], ignore_errors=True)
    return f"file://{OWN[app]}"


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches end at 4 MB of rows where the session allows more, as long texts would fill a worker otherwise."""
    now = spark.conf.get(BATCH).lower()
    unit = {"k": 10, "m": 20, "g": 30}.get(now.removesuffix("b")[-1:], 0)
    digits = "".join(c for c in now if c.isdigit())
    if not digits or int(digits) << unit > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go once it is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table or a folder by the file system that Spark uses."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def interim(spark: SparkSession) -> Iterator[None]:
    """The folders of all jobs that begin within go when it ends: for what leads to a table that is written within and kept elsewhere, by a job that
    began before."""
    token = INTERIM.set([])
    try:
        yield
    finally:
        folders = INTERIM.get()
        INTERIM.reset(token)
        for folder in folders:
            delete(spark, folder)


class Scratch:
    """The tables of one job, in a folder of its own below the shared one. A table that a later one replaces can be dropped; those that
    the job's result reads stay until whoever owns the shared folder clears it."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        if (folders := INTERIM.get()) is not None:
            folders.append(self.folder)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a Parquet table, read back."""
        with cleaned(self.spark):
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, by the file system that Spark uses."""
        for name in names:
            delete(self.spark, f"{self.folder}/{name}")


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt by its keys and never broadcast: Spark sees the size of the files that a table comes from, not that rows were
    exploded or that a file packs them well, and would send millions of them to the driver."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back."""
    return Scratch(df.sparkSession, name).keep(df, "table")
