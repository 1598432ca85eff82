"""Whole jobs: the pipeline, the benchmark and the tables of a review console."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators import evaluation, features, model, network, segments, split
from ledgerflow.operators.explain import explained
from ledgerflow.sources import sinks
from ledgerflow.sources.storage import written
from ledgerflow.sources.transactions import counted, guarded


def run_pipeline(tx: DataFrame, out: str, budget: int = 100, k: int = 5, explain: bool = True) -> tuple[DataFrame, DataFrame]:
    """Features, split, fit on the early days, score all, evaluate the late ones, write. Returns (scored, metrics).

    With explain, all written rows carry their reason and factors; scores are the same without.
    """
    return _run(written(features.account_days(tx), "features"), out, budget, k, explain)


def _run(days: DataFrame, out: str, budget: int, k: int, explain: bool) -> tuple[DataFrame, DataFrame]:
    last = split.cutoff(days)
    fitted, scored = model.fit_score(days, last, k)
    scored = written(scored, "scored")
    late = split.evaluation_rows(scored, last)
    found = written(evaluation.metrics(late, budget), "metrics")
    sinks.write_scored(explained(scored, fitted.baseline) if explain else scored, f"{out}/scored_cases")
    sinks.write_queue(evaluation.ranked_cases(late), f"{out}/investigation_queue")
    if explain:
        explained(evaluation.queue(late, budget), fitted.baseline).write.parquet(f"{out}/explained_queue")
    sinks.write_json(found, f"{out}/metrics")
    fitted.save(days.sparkSession, f"{out}/model")
    return scored, found


def run_benchmark(tx: DataFrame, out: str, report: str | None = None, wanted: Iterable[int] | None = (50, 100, 250, 500, 1000), k: int = 5, check_size: bool = True) -> DataFrame:
    """The pipeline without explanations, the capacity curve and profiles of the late rows, and a summary row."""
    tx, seen = counted(tx)  # the transactions are read once: their number comes with the features
    days = written(features.account_days(tx), "features")
    rows = guarded(seen.get["n"]) if check_size else seen.get["n"]
    scored, found = _run(days, out, 100, k, False)
    last = split.cutoff(scored)
    late = split.evaluation_rows(scored, last)
    curve = written(evaluation.capacity_curve(late, evaluation.capacities(wanted, found.first()["cases"])), "curve")
    profile = named_profiles(late)
    targets = [out] + ([report] if report else [])
    sinks.write_small_csv(curve.orderBy("capacity"), *(f"{t}/capacity_curve" for t in targets))
    sinks.write_small_csv(profile.orderBy("cluster"), *(f"{t}/cluster_profiles" for t in targets))
    found = summary(rows, scored, last, found, curve)
    for t in targets:
        sinks.write_json(found, f"{t}/benchmark_summary")
    return found


def named_profiles(rows: DataFrame) -> DataFrame:
    """segments.profiles() with cluster_name."""
    profile = segments.profiles(rows)
    return segments.named(profile, segments.name_table(rows.sparkSession, segments.segment_names(profile.collect())))  # k rows


def summary(transactions: int, scored: DataFrame, last, found: DataFrame, curve: DataFrame) -> DataFrame:
    """One row: the metrics, the transactions, first and last date and cases of both parts, and the curve as a list."""
    line = F.struct("capacity", "hits", "precision", "recall", "lift", "detected_value")
    out = found.crossJoin(curve.agg(F.sort_array(F.collect_list(line)).alias("capacity_results"))).withColumn("transactions", F.lit(transactions).cast("long"))  # one row each
    part = {r["part"]: r for r in split.parts(scored, last).collect()}
    return out.withColumns({f"{p}_{c}": F.lit(part[p][c]) for p in ("train", "evaluation") for c in ("first_date", "last_date", "cases")})


def console_tables(tx: DataFrame, scored: DataFrame, budget: int, chosen: list[int] | None = None) -> dict[str, DataFrame]:
    """What a review console shows: profiles of all rows with names, the queue of the chosen segments, its metrics, curve and networks."""
    spark: SparkSession = tx.sparkSession
    last = split.cutoff(scored)
    profile = segments.profiles(scored)
    names = segments.name_table(spark, segments.segment_names(profile.collect()))
    late = segments.named(split.evaluation_rows(scored, last), names)
    if chosen is not None:
        late = late.where(F.col("cluster").isin(chosen))
    if late.isEmpty():
        raise ValueError("no case in the chosen segments")
    alerts = written(evaluation.queue(late, budget), "alerts")
    edges = network.ego_edges(tx, alerts)
    budgets = evaluation.capacities([*range(10, 251, 10), budget], late.count())
    return {"profiles": segments.named(profile, names), "queue": alerts, "metrics": evaluation.metrics(late, budget), "curve": evaluation.capacity_curve(late, budgets), "edges": edges, "nodes": network.ego_nodes(edges, alerts)}
