"""Written results and their reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_scored(scored: DataFrame, path: str) -> None:
    scored.write.partitionBy("date").parquet(path)


def write_queue(ranked: DataFrame, path: str) -> None:
    """All cases with their rank (column rank, first), from the highest risk down: a range-partitioned sort."""
    ranked.select("rank", *(c for c in ranked.columns if c != "rank")).orderBy("rank").write.csv(path, header=True)


def write_json(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.json(path)


def write_small_csv(df: DataFrame, *paths: str) -> None:
    for path in paths:
        df.coalesce(1).write.csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_small_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
