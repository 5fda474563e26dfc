"""Table access: one Parquet file or folder per table below a base folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Scan ``{base}/{name}.parquet``; with ``columns`` only those reach the scan."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df
