"""Intermediate tables in the folder that the cluster shares.

A table written here cuts the lineage, and a lost executor costs a read instead of a recomputation.
The folder is spark.checkpoint.dir; only where that is unset (a local session) is one made.
What was shuffled for a table goes as soon as the table is written, not when the driver next collects its garbage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local session without it a temporary folder of this process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + _own.setdefault("folder", tempfile.mkdtemp(prefix="opchain-"))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when the query ends.  A stage that is tried again meanwhile still finds or remakes its input."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Named tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns a frame that reads it; `path` of the result finds it again for drop()."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def keep_dealt(self, df: DataFrame, name: str, column: str, buckets: int, dealt: bool = False) -> DataFrame:
        """keep() for a table that is joined by one column again and again: its rows are dealt out by it once, not for each join.

        dealt: the rows of a bucket are in one task already, or in few.

        Spark finds such tables by name only, so until drop() one is in the session's catalog, with its files in the shared folder.
        """
        self.n += 1
        path, table = f"{self.root}/{self.n:03d}-{name}", f"{name}_{uuid.uuid4().hex[:12]}"
        with shuffles_dropped(self.spark):
            (df if dealt else df.repartition(buckets, column)).write.bucketBy(buckets, column).format("parquet").option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out.scratch_path, out.scratch_table = path, table  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for df in frames:
            if table := getattr(df, "scratch_table", None):
                self.spark.sql(f"drop table if exists {table}")
            where = hadoop(df.scratch_path)  # type: ignore[attr-defined]
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
