"""S22 whole-table reads of the shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one whole table; Catalyst prunes columns and pushes filters
    into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view for ``spark.sql`` queries."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
