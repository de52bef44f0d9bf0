"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing Parquet under
``spark.checkpoint.dir`` and reading it back. Each table is computed once,
survives the loss of any executor, and reports exact row counts to the
planner. Where the setting is absent a local master (tests, notebooks) gets a
local folder, stored in the session; a cluster is refused, for its executors
would each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Spark then removes the shuffle files of a query when it ends; what it wrote is on the shared folder by then.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; under a local master, a new temporary one if none is set."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="grainmill-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    return folder.rstrip("/")


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


class Workspace:
    """A folder of written tables that one operator call uses.

    ``table`` writes and rereads a DataFrame; ``drop`` removes a table that no
    later plan reads. What is left goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/grainmill-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        with freeing(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)
        except Exception:  # the session may have ended; files then stay behind
            return
