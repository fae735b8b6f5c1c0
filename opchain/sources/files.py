"""Readers of sums from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_hopping(spark: SparkSession, path: str) -> DataFrame:
    """Terms h Cdag_p C_q from lines "p q h" separated by white space; lines that begin with # are comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    f = F.split("line", r"\s+")
    op = lambda name, k: F.struct(F.lit(name).alias("name"), f[k].cast("int").alias("n"))
    coeff = F.struct(f[2].cast("double").alias("re"), F.lit(0.0).alias("im"))
    return lines.select(F.monotonically_increasing_id().alias("term_id"), coeff.alias("coeff"), F.array(op("Cdag", 0), op("C", 1)).alias("ops"))


def read_terms(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Terms (term_id, coeff, ops) as written by write_terms, or by anyone in that layout."""
    return spark.read.format(kind).load(path).select("term_id", "coeff", "ops")


def write_terms(terms: DataFrame, path: str, kind: str = "parquet") -> None:
    terms.write.mode("overwrite").format(kind).save(path)
