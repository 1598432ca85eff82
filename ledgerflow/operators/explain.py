"""Why a case stands out: its largest robust deviations from its segment, in words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.schema import FEATURE_COLUMNS, FEATURES

SHARES = [f for f, *_, kind in FEATURES if kind == "share"]


def baseline_map(baselines: DataFrame) -> DataFrame:
    """One row a segment: cluster, base (feature -> median, scale)."""
    return baselines.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "scale")))).alias("base"))


def _largest(top: int) -> Callable:
    """Of each row's values, medians and scales, in feature order: the largest deviations, at most one of a group. Column expressions for 19 features make a method that Java does not compile."""
    groups = {g: i for i, g in enumerate(dict.fromkeys(g for _, _, g, _ in FEATURES))}
    group, share = np.array([groups[g] for _, _, g, _ in FEATURES]), np.array([f in SHARES for f in FEATURE_COLUMNS])
    names, sent = pa.array(FEATURE_COLUMNS), FEATURE_COLUMNS.index("out_tx_count")

    @F.arrow_udf("array<struct<feature:string,deviation:double,value:double,median:double>>")
    def largest(values: pa.Array, medians: pa.Array, scales: pa.Array) -> pa.Array:
        value, median, scale = (a.flatten() for a in (values, medians, scales))
        wide = lambda a: a.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURE_COLUMNS))
        known = wide(pc.and_(pc.and_(value.is_valid(), median.is_valid()), scale.is_valid()))
        v = wide(value)
        idle = share & (v[:, [sent]] == 0)  # shares of nothing come last
        with np.errstate(invalid="ignore"):
            key = np.where(idle, np.inf, -np.abs((v - wide(median)) / wide(scale)))
        known = known | idle
        order, row = np.argsort(key, axis=1, kind="stable"), np.arange(len(v))  # NaN after all others, ties by feature order
        met, taken, chosen = np.zeros((len(v), len(groups)), bool), np.zeros(len(v), int), np.zeros(order.shape, bool)
        for j in range(order.shape[1]):
            at = order[:, j]
            chosen[:, j] = known[row, at] & ~met[row, group[at]] & (taken < top)
            met[row, group[at]] |= chosen[:, j]
            taken += chosen[:, j]
        place = order[chosen]
        flat = pa.array(np.repeat(row, taken) * order.shape[1] + place)
        told = pa.StructArray.from_arrays([names.take(pa.array(place)), pa.array(-key.ravel()[flat.to_numpy()]), value.take(flat), median.take(flat)], ["feature", "deviation", "value", "median"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken)), pa.int32()), told)

    return largest


def factors(rows: DataFrame, baselines: DataFrame, top: int = 3) -> DataFrame:
    """rows with factors array<struct<feature, deviation, value, median>>: at most one of a group, ties by feature order."""
    each = lambda part: F.array(*(F.col("base")[f][part] for f in FEATURE_COLUMNS))
    base = baseline_map(baselines).select("cluster", each("median").alias("base_medians"), each("scale").alias("base_scales"))
    none = F.array(*[F.lit(None).cast("double")] * len(FEATURE_COLUMNS))
    joined = rows.join(F.broadcast(base), "cluster", "left")
    values = F.array(*(F.col(f).cast("double") for f in FEATURE_COLUMNS))
    return joined.withColumn("factors", _largest(top)(values, F.coalesce("base_medians", none), F.coalesce("base_scales", none))).drop("base_medians", "base_scales")


def _text(x: Column) -> Column:
    kind = F.create_map(*(F.lit(v) for f, *_, k in FEATURES for v in (f, k)))[x["feature"]]
    label = F.create_map(*(F.lit(v) for f, name, *_ in FEATURES for v in (f, name)))[x["feature"]]
    n = F.col("out_tx_count")
    percent = lambda v: F.concat(F.format_number(v * 100, 0), F.lit("%"))
    share = F.concat(F.rint(x["value"] * n).cast("long").cast("string"), F.lit(" of "), n.cast("string"), F.lit(" outgoing "), F.when(n == 1, "transaction").otherwise("transactions"), F.lit(" ("), percent(x["value"]), F.lit(") vs segment median "), percent(x["median"]), F.when(n < 3, "; limited sample").otherwise(""))
    against = lambda sign, d: F.concat(F.lit(sign), F.format_number(x["value"], d), F.lit(f" vs segment median {sign}"), F.format_number(x["median"], d))
    rest = F.when(kind == "share", share).when(kind == "money", against("$", 2)).when(kind == "count", against("", 0)).otherwise(against("", 2))
    return F.concat(F.lit("Unusual "), label, F.lit(": "), rest)


def explained(rows: DataFrame, baselines: DataFrame, top: int = 3) -> DataFrame:
    """rows with alert_reason (the first factor) and alert_factors (all of them)."""
    texts = factors(rows, baselines, top).withColumn("texts", F.transform("factors", _text))
    return texts.withColumns({"alert_reason": F.coalesce(F.get("texts", F.lit(0)), F.lit("")), "alert_factors": F.array_join("texts", " • ")}).drop("texts", "factors")


def money_text(c: Column) -> Column:
    """$1.2M, $3.4K or $56."""
    a = F.abs(c)
    return F.when(a >= 1e6, F.concat(F.lit("$"), F.format_number(c / 1e6, 1), F.lit("M"))).when(a >= 1e3, F.concat(F.lit("$"), F.format_number(c / 1e3, 1), F.lit("K"))).otherwise(F.concat(F.lit("$"), F.format_number(c, 0)))


def outcome(label: Column) -> Column:
    return F.when(label > 0, "Confirmed laundering").otherwise("Unconfirmed")


def queue_view(ranked: DataFrame, reveal: bool = False) -> DataFrame:
    """The analyst's columns; the label only when revealed."""
    base = ["rank", "case_id", "date", "account_id", "cluster", "risk_score", "total_tx_count", "total_value", "flow_ratio"]
    return ranked.select(*base, *([outcome(F.col("is_laundering")).alias("outcome")] if reveal else []))


__all__ = ["FEATURE_COLUMNS", "baseline_map", "explained", "factors", "money_text", "outcome", "queue_view"]
