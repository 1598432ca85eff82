"""Exact quantiles of many columns at any size, in two passes over the rows.

The first pass sketches every column and brackets each quantile between two values. The second counts what lies
below each bracket, and how often each value inside stands; those few values are ranked over ranges, and the two around
each position are interpolated. Counts prove that a bracket holds its positions; one that does not is opened and counted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import ranking
from ledgerflow.sources.storage import written

#: Accuracy of the sketches, and width of a bracket to either side in ranks of the sketch.
ACCURACY, MARGIN = 2_000, 3


def _brackets(wide: DataFrame, names: Sequence[str], at: Sequence[float], by: list[str]) -> DataFrame:
    """(by, name, n, lows, highs): for each column its values, and a lower and an upper bound of each quantile."""
    e, k = MARGIN / ACCURACY, len(at)
    ps = F.array(*(F.lit(min(max(p + s * e, 0.0), 1.0)) for s in (-1, 1) for p in at))
    per = [(F.count(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", ps, ACCURACY).alias(f"v{i}")) for i in range(len(names))]
    found = wide.groupBy(*by).agg(F.count("*").alias("rows_"), *(c for pair in per for c in pair)).where("rows_ > 0")
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"v{i}").alias("v")) for i, name in enumerate(names)))
    return found.select(*by, F.inline(each)).select(*by, "name", "n", F.slice("v", 1, k).alias("lows"), F.slice("v", k + 1, k).alias("highs"))


def _counts(bounds: dict[int, dict[int, tuple[list, list]]]) -> Callable:
    """Of a batch's rows (g_, c0, c1...): for each group, column and quantile the values below its bracket (value null), and how often each value inside stands. bounds: group -> column -> (lows, highs)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, found = batch.column("g_").to_numpy(), []
            for g in np.unique(group):
                rows = pa.array(np.flatnonzero(group == g))
                for i, (lows, highs) in bounds.get(int(g), {}).items():
                    v = batch.column(f"c{i}").take(rows).drop_null().to_numpy()
                    for p, (low, high) in enumerate(zip(lows, highs, strict=True)):
                        # NaN is the largest value, as in Spark
                        under = v < low if low == low else v == v
                        inside, n = np.unique(v[~under & ((v <= high) | (high != high))], return_counts=True)
                        found.append((g, i, p, np.append(inside, 0.0), np.append(n, under.sum())))
            size = [len(x[3]) for x in found]
            g, i, p = (pa.array(np.repeat(np.array([x[j] for x in found], np.int32), size)) for j in range(3))
            value, n = (np.concatenate([x[j] for x in found]) if found else np.zeros(0) for j in (3, 4))
            last = np.zeros(len(value), bool)
            last[np.cumsum(size, dtype=np.int64) - 1] = True
            yield pa.RecordBatch.from_arrays([g, i, p, pa.array(value, mask=last), pa.array(n.astype(np.int64))], names=["g_", "i_", "p", "value", "n"])

    return counts


def _counted(wide: DataFrame, names: Sequence[str], by: list[str], brackets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((by, name, p, below), (by, name, p, value, n)): values below each bracket, and those inside, from one scan."""
    place, got = {n: i for i, n in enumerate(names)}, brackets.collect()  # a row for each column of each group
    groups = {g: k for k, g in enumerate(dict.fromkeys(tuple(r[c] for c in by) for r in got))}
    bounds: dict = {}
    for r in got:
        if r["n"]:
            bounds.setdefault(groups[tuple(r[c] for c in by)], {})[place[r["name"]]] = (r["lows"], r["highs"])
    spark, kind = wide.sparkSession, T.StructType([*(wide.schema[c] for c in by), T.StructField("g_", T.IntegerType())])
    of = F.broadcast(spark.createDataFrame([(*g, k) for g, k in groups.items()], kind)) if by else None
    numbered = wide.join(of, by) if by else wide.withColumn("g_", F.lit(0))
    found = numbered.select("g_", *(f"c{i}" for i in range(len(names)))).mapInArrow(_counts(bounds), "g_ int, i_ int, p int, value double, n bigint")
    found = written(found.groupBy("g_", "i_", "p", "value").agg(F.sum("n").alias("n")), "counted")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("i_") + 1).alias("name")
    found = (found.join(of, "g_") if by else found).select(*by, name, "p", "value", "n")
    return found.where("value is null").select(*by, "name", "p", F.col("n").alias("below")), found.where("value is not null")


def quantiles(rows: DataFrame, columns: dict[str, Column], at: Sequence[float], by: Sequence[str] = (), accuracy_first: bool = True) -> DataFrame:
    """(by, name, n, q array<double>): quantiles of each column of numbers in each group, interpolated between the two values around p * (n - 1). Nulls do not count; a column without values has nulls.

    by: columns without nulls, of few groups (a row for each is broadcast). accuracy_first False skips the sketches and opens every bracket, for tests.
    """
    by, k, names = list(by), len(at), list(columns)
    group, key = [*by, "name"], [*by, "name", "p"]
    wide = rows.select(*by, *(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())))
    brackets = written(_brackets(wide, names, at, by), "brackets")
    wide_open = dict(zip(("lows", "highs"), (F.array(*[F.lit(float(f"{s}inf"))] * k) for s in "-+"), strict=True))
    if not accuracy_first:
        brackets = brackets.withColumns(wide_open)
    position = F.element_at(F.array(*map(F.lit, map(float, at))), F.col("p") + 1) * (F.col("n") - 1)
    for last in (False, True):
        below, inside = _counted(wide, names, by, brackets)
        inside = ranking.in_ranges(inside, [F.col("value")], key)
        asked = brackets.select(*group, "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("p"))
        ends = asked.join(below, key, "left").join(inside.groupBy(*key).agg(F.sum("n").alias("inside")), key, "left").withColumn("at", position)
        ends = written(ends.fillna(0, ["below", "inside"]), "ends")
        missed = ends.where((F.col("n") > 0) & ((F.floor("at") < F.col("below")) | (F.ceil("at") >= F.col("below") + F.col("inside"))))
        if last or missed.isEmpty():
            break
        brackets = brackets.withColumns(wide_open)
    first = ranking.joined(inside.withColumnRenamed("n", "m"), ranking.before(inside, key, earlier=F.sum("n")), key)
    first = first.withColumn("upto", F.col("earlier") + F.sum("m").over(Window.partitionBy(*key, "part_").orderBy("value")))
    met = first.join(ends.select(*key, "at", "below"), key).withColumn("upto", F.col("below") + F.col("upto"))
    pick = lambda place: F.max(F.when((F.col("upto") - F.col("m") <= place) & (place < F.col("upto")), F.col("value")))
    low, high = pick(F.floor("at")), pick(F.ceil("at"))
    per = met.groupBy(*key).agg(low.alias("low"), high.alias("high"), F.first("at").alias("at"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    per = per.select(*key, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(value).alias("q"))
    found = ends.select(*key, "n").join(per, key, "left").groupBy(*by, "name").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("p", "q"))).alias("q"))
    return found.select(*by, "name", "n", F.array(*(F.col("q")[p] for p in range(k))).alias("q"))
