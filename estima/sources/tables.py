"""Columnar tables (parquet) and the load report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def scan_table(spark: SparkSession, base: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read ``{base}/{name}.parquet``; a column list is pushed into the scan."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def load_report(df: DataFrame) -> DataFrame:
    """Rows x columns of a loaded input, as one row ``(n_rows, n_columns)``.

    The row count is an aggregate (parquet answers it from footers); the column
    count is schema metadata.
    """
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"))
