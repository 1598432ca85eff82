"""Segments: assignment to centres, profiles, baselines and names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.schema import FEATURE_COLUMNS, SEGMENT_NAMES
from ledgerflow.operators.quantiles import quantiles


MEDIANS = {"median_transactions": "total_tx_count", "median_value": "total_value", "median_cross_currency_share": "cross_currency_share", "median_cash_share": "cash_share", "median_flow_ratio": "flow_ratio"}


def profiles(scored: DataFrame) -> DataFrame:
    """cluster, cases and six exact medians."""
    if lost := {"cluster", *FEATURE_COLUMNS} - set(scored.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(lost))}")
    of = {n: F.col(c) for n, c in MEDIANS.items()} | {"median_counterparties": F.col("unique_out_counterparties") + F.col("unique_in_counterparties")}
    q = quantiles(scored, {"cases": F.lit(0)} | of, [0.5], ["cluster"]).groupBy("cluster")
    named = lambda n, v: F.max(F.when(F.col("name") == n, v)).alias(n)
    order = ("median_transactions", "median_value", "median_counterparties", "median_cross_currency_share", "median_cash_share", "median_flow_ratio")
    return q.agg(named("cases", F.col("n")), *(named(n, F.col("q")[0]) for n in order))


def baselines(train: DataFrame) -> DataFrame:
    """cluster, feature, median, scale: q75 - q25, else the sample deviation, else 1; exact."""
    q = quantiles(train, {c: F.col(c) for c in FEATURE_COLUMNS}, [0.25, 0.5, 0.75], ["cluster"])
    wide = train.groupBy("cluster").agg(*(F.stddev_samp(c).alias(c) for c in FEATURE_COLUMNS))
    spread = wide.select("cluster", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.nullif(F.nanvl(F.col(c), F.lit(None)), F.lit(0.0)).alias("s")) for c in FEATURE_COLUMNS))))
    met = q.withColumnRenamed("name", "feature").join(spread, ["cluster", "feature"])
    return met.select("cluster", "feature", F.col("q")[1].alias("median"), F.coalesce(F.nullif(F.col("q")[2] - F.col("q")[0], F.lit(0.0)), "s", F.lit(1.0)).alias("scale"))


def nearest(columns: list[np.ndarray], centers: dict[int, list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre, the lowest number of ties, and its distance) of each point. Terms are added in the order of the columns; NaN is the largest distance, as in Spark."""
    at = best = None
    for k, center in sorted(centers.items()):
        far = np.zeros(len(columns[0]))
        for x, v in zip(columns, center, strict=True):
            far += (x - v) * (x - v)
        far = np.sqrt(far)
        if best is None:
            at, best = np.full(len(far), k, np.int32), far
        else:
            closer = (far < best) | (np.isnan(best) & ~np.isnan(far))
            at[closer], best[closer] = k, far[closer]
    return at, best


def assigned(rows: DataFrame, columns: list[str], centers: dict[int, list[float]]) -> DataFrame:
    """rows with cluster (the nearest centre, the lowest number of ties) and center_distance (null if a column is). Column expressions for 19 columns make a method that Java does not compile."""

    @F.arrow_udf("cluster int, center_distance double")
    def near(x: pa.Array) -> pa.Array:
        parts = x.flatten()
        at, far = nearest([c.to_numpy(zero_copy_only=False) for c in parts], centers)
        lost = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in parts], axis=0)
        return pa.StructArray.from_arrays([pa.array(np.where(lost, min(centers), at), pa.int32()), pa.array(far, mask=lost)], ["cluster", "center_distance"])

    return rows.withColumn("near", near(F.struct(*(F.col(c).cast("double").alias(c) for c in columns)))).withColumns({"cluster": F.col("near.cluster"), "center_distance": F.col("near.center_distance")}).drop("near")


def segment_names(profile_rows: list) -> dict[int, str]:
    """Distinct names (k rows on the driver).

    A segment's candidates are the sides of its medians, by how far each lies from the median of the segments in spreads. The
    segment that lies furthest out is named first; each takes its best candidate that is free, or its best one if none is.
    """
    import pandas as pd

    medians = [c for c, *_ in SEGMENT_NAMES]
    table = pd.DataFrame([[r[c] for c in medians] for r in profile_rows], [r["cluster"] for r in profile_rows], medians, float)
    quarter = table.quantile(0.75) - table.quantile(0.25)
    spread = quarter.where(quarter != 0, table.std(ddof=1)).replace(0, np.nan).fillna(1.0)
    out = (table - table.median()) / spread
    sides = {c: (low, high) for c, high, low in SEGMENT_NAMES}
    best = {int(k): sorted(((abs(v), sides[c][v >= 0]) for c, v in row.items()), reverse=True) for k, row in out.iterrows()}
    names: dict[int, str] = {}
    for k, candidates in sorted(best.items(), key=lambda kv: -kv[1][0][0]):
        names[k] = next((n for _, n in candidates if n not in names.values()), candidates[0][1])
    return names


def name_table(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(names.items()), "cluster int, cluster_name string")


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with cluster_name; names has one row a segment."""
    return rows.join(F.broadcast(names), "cluster", "left")
