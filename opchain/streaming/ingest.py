"""Terms that arrive as a stream: partial sums of each batch are kept, and their sum is the sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opchain.operators.terms import append, combine
from opchain.sources.catalog import Catalog


def stream_terms(terms: DataFrame, catalog: Catalog, out: str, checkpoint: str, abs_tol: float = 0.0, **trigger) -> StreamingQuery:
    """Starts to ingest a stream of terms (term_id, coeff, ops).  Each batch's like terms are added up and written under `out`, in a folder named by its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        combine(append(batch, catalog, abs_tol), 0.0).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = terms.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, out: str, abs_tol: float = 0.0) -> DataFrame:
    """(ops, re, im) of all batches so far; the tolerance applies to the whole sum."""
    total = spark.read.parquet(out).groupBy("ops").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return total.where(F.hypot("re", "im") > abs_tol)
