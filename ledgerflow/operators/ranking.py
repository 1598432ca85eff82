"""Places in an order over any number of rows, without bringing them into one task.

Rows are dealt to ranges of the order, counted for each range, and numbered inside it after those of the ranges
before: one sort by range, and a running sum over as many rows as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.sources.storage import written


def in_ranges(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """df as a written table with part_: the number of its range of (by, order); every row of a range comes before those of the next."""
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return written(dealt.withColumn("part_", F.spark_partition_id()), "ranges")


def before(parts: DataFrame, by: Sequence[str] = (), **sums: Column) -> DataFrame:
    """(by, part_, each sum over the ranges before): a row for each range, and for each group in it."""
    down = Window.partitionBy(*by, *([] if by else [F.lit(1)])).orderBy("part_")
    per = parts.groupBy(*by, "part_").agg(*(v.alias(k) for k, v in sums.items()))
    return per.select(*by, "part_", *((F.sum(k).over(down) - F.col(k)).alias(k) for k in sums))


def joined(parts: DataFrame, sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """parts with the sums of the ranges before them. Without groups there is one row for each range, a number that the session bounds; else Spark chooses the join."""
    return parts.join(sums if by else F.broadcast(sums), [*by, "part_"])


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with its place (long, from 1) in the order, in each group of by (columns without nulls). Rows equal in the whole order come in any order."""
    parts = in_ranges(df, order, by)
    inside = F.row_number().over(Window.partitionBy(*by, "part_").orderBy(*order))
    with_sums = joined(parts, before(parts, by, rows_before_=F.count("*")), by)
    return with_sums.withColumn(name, F.col("rows_before_") + inside).select(*df.columns, name)
