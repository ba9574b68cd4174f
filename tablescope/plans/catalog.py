"""Driver tables by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tablescope.sources.tables import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, filters: Mapping[str, object] | None = None) -> DataFrame:
    """A driver table with NaN as null; ``filters`` reach the Parquet scan."""
    if name not in TABLES:
        raise KeyError(name)
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", filters=filters)
