"""Intermediate tables in the folder that the driver and all executors share.

Executors may be lost at any time, so a lineage is cut with tables written there, never with local copies. Once a
table is written, the shuffle files of the query that made it serve nobody, and Spark deletes them with the query
(``fileCleanup``); so what lies on disk is what the plan's present step needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a folder of our own, but only if there is no other machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: executors of a cluster need a folder that they share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        shared_dir.own = base
    return base.rstrip("/")


#: While a table is written: rows and bytes of an Arrow batch (whole texts, so far fewer rows than Spark's 10,000), shuffle files, and
#: folders that a task may write to at once, before it sorts its rows by them.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within the block and are as before after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """A folder of Parquet tables for one run of an operator."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tallyforge/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None, more: bool = False) -> DataFrame:
        """``by``: the last column, whose values are folders of the table. ``more``: to what the table has."""
        with settings(self.spark, WRITING):
            df.write.mode("append" if more else "overwrite").parquet(self.path(name), partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no DataFrame needs any more."""
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        """Deletes all tables, when nothing needs them any more."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
