"""Reading tables; the shared scratch folder and connected components are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.functions.graph import connected_components, forget, maybe_broadcast, passing, settle, small_enough

__all__ = ["connected_components", "forget", "fresh", "maybe_broadcast", "passing", "settle", "small_enough", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever the case: `name`, with as many underscores after it as that takes."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name
