"""Preparation and robust scaling of the features; the parameters are one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.schema import FEATURE_COLUMNS, LINEAR
from ledgerflow.operators.quantiles import quantiles


def prepared(name: str) -> Column:
    x = F.col(name).cast("double")
    x = x if name in LINEAR else F.log1p(F.greatest(x, F.lit(0.0)))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x)


def prepare(features: DataFrame) -> DataFrame:
    """log1p of sizes; shares and the flow ratio stay; no infinities."""
    return features.select("case_id", *(prepared(c).alias(c) for c in FEATURE_COLUMNS))


def scaler_table(train: DataFrame) -> DataFrame:
    """feature, center (median), spread (q90 - q10, or 1 where that is 0); exact."""
    q = quantiles(train, {c: prepared(c) for c in FEATURE_COLUMNS}, (0.1, 0.5, 0.9))
    return q.select(F.col("name").alias("feature"), F.col("q")[1].alias("center"), F.coalesce(F.nullif(F.col("q")[2] - F.col("q")[0], F.lit(0.0)), F.lit(1.0)).alias("spread"))


def scaled_columns(scaler: dict[str, tuple[float, float]]) -> list[Column]:
    return [((prepared(c) - scaler[c][0]) / scaler[c][1]).alias(c) for c in FEATURE_COLUMNS]


def scaler_of(train: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["center"], r["spread"]) for r in scaler_table(train).collect()}  # one row a feature
