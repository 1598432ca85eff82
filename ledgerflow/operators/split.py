"""Split by date without leakage: whole days, by volume of cases, never the last day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.schema import LABEL
from ledgerflow.operators.features import cases_per_day


def running_days(features: DataFrame) -> DataFrame:
    """date, cases, running cases, total: one row a day, so the window is small whatever the cases."""
    days = Window.orderBy("date")
    per = cases_per_day(features)
    return per.withColumn("running", F.sum("cases").over(days)).withColumn("total", F.sum("cases").over(Window.partitionBy(F.lit(1)))).withColumn("last", F.max("date").over(Window.partitionBy(F.lit(1))))


def cutoff_table(features: DataFrame, fraction: float = 0.7) -> DataFrame:
    """One row: the day whose running cases are nearest the fraction (the first of ties), its running cases, and all cases."""
    gap = F.abs(F.col("running") - F.col("total") * fraction)
    return running_days(features).where("date < last").agg(F.min_by(F.struct("date", "running", "total"), F.struct(gap, "date")).alias("x")).select(F.col("x.date").alias("cutoff"), F.col("x.running").alias("train_cases"), F.col("x.total").alias("cases"))


def cutoff(features: DataFrame, fraction: float = 0.7) -> date:
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    found = cutoff_table(features, fraction).first()["cutoff"]
    if found is None:
        raise ValueError("at least two days are needed")
    return found


def train_rows(features: DataFrame, last: date) -> DataFrame:
    return features.where(F.col("date") <= F.lit(last))


def evaluation_rows(features: DataFrame, last: date) -> DataFrame:
    return features.where(F.col("date") > F.lit(last))


def without_cases(features: DataFrame, cases: DataFrame) -> DataFrame:
    return features.join(cases.select("case_id"), "case_id", "left_anti")


def parts(features: DataFrame, last: date) -> DataFrame:
    """First and last day, cases, positives and prevalence of each part."""
    part = F.when(F.col("date") <= F.lit(last), "train").otherwise("evaluation")
    return features.groupBy(part.alias("part")).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("cases"), F.sum(LABEL).cast("long").alias("positives"), F.avg(LABEL).alias("prevalence"))
