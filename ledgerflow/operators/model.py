"""The risk model: segments, isolation forests, percentiles against the training rows, risk.

A fitted model is a set of small parameter tables; scoring is a map over the rows with the parameters in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions.schema import FEATURE_COLUMNS
from ledgerflow.operators import ranking
from ledgerflow.operators.scaling import scaled_columns, scaler_of
from ledgerflow.operators.segments import assigned, baselines, nearest
from ledgerflow.operators.split import train_rows
from ledgerflow.sources.storage import written

SEED, SAMPLE, DRAWN, GLOBAL_TREES, SEGMENT_TREES = 42, 256, 1_024, 250, 200
#: Starts of the segmentation, rows that they are drawn from, most rounds, and the gain of a round at which they end.
STARTS, STARTING, ROUNDS, TOLERANCE = 10, 10_000, 40, 1e-4
#: Starts whose costs differ by this share or less hold the same segments in another order: the first is taken, as their sums differ by the order of rows.
ALIKE = 1e-9
LEAST_SEGMENT = max(30, 3 * len(FEATURE_COLUMNS))
#: Distinct reference values up to which a reference is held in the tasks (16 MB); a larger one stays a table.
IN_TASKS = 1_000_000
TREE = "scope int, tree int, node int, feature int, threshold double, left int, right int, length double"


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """One isolation tree as rows (feature or -1, threshold, left, right, path length at a leaf)."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[tuple[int, float, int, int, float]] = [(-1, 0.0, -1, -1, 0.0)]
    work = [(0, points, 0)]
    while work:
        at, p, depth = work.pop()
        span = p.max(0) - p.min(0) if len(p) else np.zeros(p.shape[1])
        open_ = np.flatnonzero(span > 0)
        if depth >= limit or len(p) <= 1 or not len(open_):
            nodes[at] = (-1, 0.0, -1, -1, depth + mean_path(len(p)))
            continue
        f = int(rng.choice(open_))
        t = float(rng.uniform(p[:, f].min(), p[:, f].max()))
        left = p[:, f] <= t
        nodes[at] = (f, t, len(nodes), len(nodes) + 1, 0.0)
        work += [(len(nodes), p[left], depth + 1), (len(nodes) + 1, p[~left], depth + 1)]
        nodes += [(-1, 0.0, -1, -1, 0.0)] * 2
    return nodes


def _trees_of(case: Column, scope: Column, n: Column, trees: int, seed: int) -> Column:
    """The trees that a row is dealt to, by one hash: about DRAWN rows a tree, whatever the rows and trees.

    With many rows most go to no tree; with few a row goes to several, from a place on and by a step (prime to their number) of its own.
    """
    h = F.xxhash64(case, scope, F.lit(seed))
    u = F.pmod(h, F.lit(1 << 40)) / float(1 << 40)
    each = F.lit(float(trees * DRAWN)) / n  # trees a row
    place = F.floor(u * trees).cast("int")
    steps = [k for k in range(1, trees) if math.gcd(k, trees) == 1] or [1]
    step = F.element_at(F.array(*map(F.lit, steps)), F.pmod(F.shiftrightunsigned(h, 40), F.lit(len(steps))).cast("int") + 1)
    several = F.transform(F.sequence(F.lit(0), F.least(F.ceil(each), F.lit(trees)).cast("int") - 1), lambda k: F.pmod(place + k * step, F.lit(trees)).cast("int"))
    return F.when(each >= 1, several).when(u < each, F.array(F.floor(u / each * trees).cast("int"))).otherwise(F.array().cast("array<int>"))


def build_forest(near: DataFrame, members: dict[int, int], seed: int = SEED) -> DataFrame:
    """Trees of every scope (-1: all rows; else a segment of members with enough rows), grown in parallel.

    One pass deals each row to a few trees of both its scopes by two hashes; a tree takes the SAMPLE rows of the least hash of those
    dealt to it. Every row can be drawn, and what goes over the network does not grow with the rows.
    """
    total = sum(members.values())
    sized = {k: n for k, n in members.items() if n >= LEAST_SEGMENT}
    dealt = lambda scope, n, trees: F.transform(_trees_of(F.col("case_id"), scope, n, trees, seed), lambda t: F.struct(scope.alias("scope"), t.alias("tree")))
    both = dealt(F.lit(-1), F.lit(float(total)), GLOBAL_TREES)
    if sized:
        size = F.element_at(F.create_map(*(F.lit(v) for k, n in sized.items() for v in (k, float(n)))), F.col("cluster"))
        both = F.when(F.col("cluster").isin(list(sized)), F.concat(both, dealt(F.col("cluster"), size, SEGMENT_TREES))).otherwise(both)
    drawn = near.select(F.explode(both).alias("d"), "case_id", *FEATURE_COLUMNS).select("d.scope", "d.tree", F.xxhash64("case_id", "d.scope", "d.tree", F.lit(seed)).alias("h"), "case_id", *FEATURE_COLUMNS)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        s, t = int(pdf["scope"].iloc[0]), int(pdf["tree"].iloc[0])
        points = pdf.sort_values(["h", "case_id"]).head(SAMPLE)[FEATURE_COLUMNS].to_numpy(float)
        rows = grow(points, np.random.default_rng((seed + s + 1, t)))
        return pd.DataFrame([(s, t, k, *r) for k, r in enumerate(rows)], columns=[c.split()[0] for c in TREE.split(", ")])

    return drawn.groupBy("scope", "tree").applyInPandas(tree, TREE)


def _sums(columns: list[str], centers: np.ndarray) -> Callable:
    """For every start at once: the rows nearest to each centre, their sums, and their squared distances."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, k, d = centers.shape
        n, total, cost = np.zeros((s, k)), np.zeros((s, k, d)), np.zeros((s, k))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            for i, c in enumerate(centers):
                far = (c * c).sum(1) - 2 * x @ c.T
                at = far.argmin(1)
                n[i] += np.bincount(at, minlength=k)
                cost[i] += np.bincount(at, far[np.arange(len(x)), at] + (x * x).sum(1), k)
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), at] = 1
                total[i] += one.T @ x
        i, j = (a.ravel() for a in np.indices((s, k)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n.ravel()), pa.array(cost.ravel()), pa.array(list(total.reshape(-1, d)), pa.list_(pa.float64()))], names=["start", "k", "n", "cost", "total"])

    return sums


def lloyd_round(rows: DataFrame, columns: list[str], centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the next centres of every start, the costs of the given ones), from one scan: each task sends one row for each centre, and the driver gets their sums."""
    s, k, d = centers.shape
    parts = rows.select(*columns).mapInArrow(_sums(columns, centers), "start int, k int, n double, cost double, total array<double>")
    found = parts.groupBy("start", "k").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*(F.sum(F.col("total")[i]) for i in range(d))).alias("total"))
    out, cost = centers.copy(), np.zeros(s)
    for r in found.collect():  # starts x centres
        cost[r["start"]] += r["cost"]
        if r["n"]:
            out[r["start"], r["k"]] = np.array(r["total"]) / r["n"]
    return out, cost


def first_centers(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres among some points, each drawn in proportion to the squared distance from those before (k-means++), then moved until they rest."""
    chosen = [points[rng.integers(len(points))]]
    for _ in range(k - 1):
        far = np.min([((points - c) ** 2).sum(1) for c in chosen], axis=0)
        chosen.append(points[rng.choice(len(points), p=far / far.sum())] if far.sum() else points[rng.integers(len(points))])
    centers = np.array(chosen)
    for _ in range(ROUNDS):
        at = ((centers * centers).sum(1) - 2 * points @ centers.T).argmin(1)
        moved = np.array([points[at == j].mean(0) if (at == j).any() else centers[j] for j in range(k)])
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def segment_centers(rows: DataFrame, columns: list[str], k: int, seed: int = SEED, starts: int = STARTS) -> np.ndarray:
    """k centres of the rows: starts from STARTING rows of the least hash, then rounds over all rows for all starts at once, and the cheapest start."""
    first = rows.orderBy(F.xxhash64("case_id", F.lit(seed)), "case_id").limit(STARTING).select(*columns).toPandas().to_numpy(float)  # a fixed number of rows
    centers = np.array([first_centers(first, k, np.random.default_rng((seed, s))) for s in range(starts)])
    best, before = centers[0], np.inf
    for _ in range(ROUNDS):
        moved, cost = lloyd_round(rows, columns, centers)
        best = centers[np.flatnonzero(cost <= cost.min() * (1 + ALIKE))[0]]
        if before - cost.min() <= TOLERANCE * cost.min():
            break
        before, centers = cost.min(), moved
    return best


@dataclass
class Forest:
    """The nodes of one scope as flat arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    size: int

    @classmethod
    def of(cls, nodes: pd.DataFrame, size: int) -> Forest:
        nodes = nodes.sort_values(["tree", "node"])
        count = nodes.groupby("tree").size().to_numpy()
        base = np.cumsum(count) - count
        shift = np.repeat(base, count)
        return cls(*(nodes[c].to_numpy() for c in ("feature", "threshold")), nodes["left"].to_numpy() + shift, nodes["right"].to_numpy() + shift, nodes["length"].to_numpy(), base, size)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """Of each point. A leaf leads to itself, so all points take the same number of steps."""
        leaf, node = self.feature < 0, np.arange(len(self.feature))
        feature, threshold = np.where(leaf, 0, self.feature), np.where(leaf, np.inf, self.threshold)
        next_ = np.column_stack([np.where(leaf, node, self.right), np.where(leaf, node, self.left)]).ravel()  # past the threshold or not a number, then within it
        steps, reached = 0, self.roots
        while len(reached := reached[~leaf[reached]]):
            steps, reached = steps + 1, np.concatenate([self.left[reached], self.right[reached]])
        total, flat = np.zeros(len(x)), np.ascontiguousarray(x, float).ravel()
        first = np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(steps):
                at = next_[2 * at + (flat[first + feature[at]] <= threshold[at])]
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / max(mean_path(self.size), 1e-12))


def reference_counts(rows: DataFrame, column: str) -> DataFrame:
    """(cluster, value, n): how often each value stands in each segment."""
    return rows.groupBy("cluster", F.col(column).alias("value")).agg(F.count("*").alias("n"))


def rank_shares(rows: DataFrame, counts: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the share of their segment's reference values that are at most theirs; 0 without a reference.

    The distinct values of both are dealt to ranges; counts run inside a range, after those of the ranges before, so no segment is one task.
    """
    asked = rows.select("cluster", F.col(column).alias("value"), F.lit(0).cast("long").alias("n"))
    per = counts.select("cluster", "value", "n").unionByName(asked).groupBy("cluster", "value").agg(F.sum("n").alias("n"))
    parts = ranking.in_ranges(per, [F.col("value")], ["cluster"])
    parts = ranking.joined(parts, ranking.before(parts, ["cluster"], earlier=F.sum("n")), ["cluster"])
    upto = F.col("earlier") + F.sum("n").over(Window.partitionBy("cluster", "part_").orderBy("value"))
    total = counts.groupBy("cluster").agg(F.sum("n").alias("all_"))
    share = parts.withColumn("upto", upto).join(total, "cluster", "left").select("cluster", F.col("value").alias(column), F.coalesce(F.try_divide(F.col("upto").cast("double"), "all_"), F.lit(0.0)).alias(name))
    return rows.join(share, ["cluster", column])


@dataclass
class Reference:
    """The reference values of each segment, all of them: as sorted arrays in the tasks where they fit, else as a table of counts. Shares are the same."""

    counts: DataFrame
    #: values and running counts of each segment, in order
    arrays: dict[int, tuple[np.ndarray, np.ndarray]] | None

    @classmethod
    def of(cls, rows: DataFrame, column: str, most: int = IN_TASKS) -> Reference:
        return cls.read(written(reference_counts(rows, column), "reference"), most)

    @classmethod
    def read(cls, counts: DataFrame, most: int = IN_TASKS) -> Reference:
        if counts.count() > most:
            return cls(counts, None)
        got = counts.toPandas().sort_values(["cluster", "value"])  # at most that many values
        return cls(counts, {int(k): (g["value"].to_numpy(float), np.cumsum(g["n"].to_numpy())) for k, g in got.groupby("cluster")})

    def shares(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """rows with the share of the segment's reference values that are at most the row's."""
        if self.arrays is None:
            return rank_shares(rows, self.counts, column, name)
        arrays = self.arrays

        @F.pandas_udf("double")
        def share(cluster: pd.Series, value: pd.Series) -> pd.Series:
            out = np.zeros(len(value))
            for k in cluster.unique():
                at = (cluster == k).to_numpy()
                if int(k) in arrays:
                    values, upto = arrays[int(k)]
                    out[at] = np.concatenate(([0], upto))[np.searchsorted(values, value.to_numpy()[at], side="right")] / upto[-1]
            return pd.Series(out)

        return rows.withColumn(name, share("cluster", column))


def risk(anomaly: Column, distance: Column) -> Column:
    """0..100 at two decimals, halves to even."""
    raw = F.lit(100.0) * (F.lit(0.82) * anomaly + F.lit(0.18) * distance)
    return F.rint(F.lit(100.0) * F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))) / F.lit(100.0)


@dataclass
class RiskModel:
    scaler: dict[str, tuple[float, float]]
    centers: dict[int, list[float]]
    trees: pd.DataFrame
    sizes: dict[int, int]
    anomaly_ref: Reference | None
    distance_ref: Reference | None
    axes: list[list[float]]
    mean: list[float]
    baseline: DataFrame | None

    def _scored(self, features: DataFrame) -> DataFrame:
        """features with cluster, center_distance, anomaly and map coordinates, all from one pass of the scaled values through the tasks."""
        kept = [c for c in features.columns if c not in FEATURE_COLUMNS]
        centers, mean, axes = self.centers, self.mean, self.axes
        forests_of = features.sparkSession.sparkContext.broadcast({int(s): Forest.of(n, self.sizes[int(s)]) for s, n in self.trees.groupby("scope")})

        @F.arrow_udf("cluster int, center_distance double, anomaly double, embedding_x double, embedding_y double")
        def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            forests = forests_of.value
            for part in parts:
                points = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
                columns = list(np.ascontiguousarray(points.T))
                cluster, far = nearest(columns, centers)
                anomaly = np.zeros(len(points))
                for k in np.unique(cluster):
                    at = cluster == k
                    anomaly[at] = forests.get(int(k), forests[-1]).anomaly(points[at])
                on = [sum(((x - m) * a for x, m, a in zip(columns, mean, axis, strict=True)), np.zeros(len(points))) for axis in axes]
                yield pa.StructArray.from_arrays([pa.array(v) for v in (cluster, far, anomaly, *on)], ["cluster", "center_distance", "anomaly", "embedding_x", "embedding_y"])

        rows = features.select(*kept, *FEATURE_COLUMNS, found(F.array(*scaled_columns(self.scaler))).alias("found"))
        return rows.select(*kept, *FEATURE_COLUMNS, "found.*")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """The rows of _scored() with both percentiles and risk."""
        rows = self.distance_ref.shares(self.anomaly_ref.shares(rows, "anomaly", "anomaly_percentile"), "center_distance", "cluster_distance_percentile")
        last = ["anomaly_percentile", "cluster_distance_percentile", "risk_score", "embedding_x", "embedding_y"]
        rows = rows.withColumn("risk_score", risk(F.col("anomaly_percentile"), F.col("cluster_distance_percentile"))).drop("anomaly", "center_distance")
        return rows.select(*(c for c in rows.columns if c not in last), *last)

    def score(self, features: DataFrame) -> DataFrame:
        """features with cluster, both percentiles, risk and map coordinates: no shuffle, unless the references are too large for the tasks."""
        rows = self._scored(features)
        if self.anomaly_ref.arrays is None or self.distance_ref.arrays is None:
            rows = written(rows, "scored")  # the forests run once, whatever the ranks read
        return self._ranked(rows)

    def _refer(self, scored: DataFrame) -> None:
        """Take the references and baselines from the training rows of a written _scored()."""
        self.anomaly_ref, self.distance_ref = Reference.of(scored, "anomaly"), Reference.of(scored, "center_distance")
        self.baseline = written(baselines(scored), "baselines")

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameter tables as Parquet."""
        spark.createDataFrame([(f, *v) for f, v in self.scaler.items()], "feature string, center double, spread double").write.parquet(f"{path}/scaler")
        spark.createDataFrame([(k, v) for k, v in self.centers.items()], "cluster int, center array<double>").write.parquet(f"{path}/centers")
        spark.createDataFrame(self.trees, TREE).write.parquet(f"{path}/trees")
        spark.createDataFrame([(k, v) for k, v in self.sizes.items()], "scope int, size int").write.parquet(f"{path}/sizes")
        for name, reference in (("anomaly", self.anomaly_ref), ("distance", self.distance_ref)):
            reference.counts.write.parquet(f"{path}/reference_{name}")
        spark.createDataFrame([("mean", self.mean), ("x", self.axes[0]), ("y", self.axes[1])], "name string, v array<double>").write.parquet(f"{path}/axes")
        self.baseline.write.parquet(f"{path}/baselines")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        scaler = {r["feature"]: (r["center"], r["spread"]) for r in read("scaler").collect()}
        refs = {n: Reference.read(read(f"reference_{n}")) for n in ("anomaly", "distance")}
        axes = {r["name"]: list(r["v"]) for r in read("axes").collect()}
        return cls({f: scaler[f] for f in FEATURE_COLUMNS}, {r["cluster"]: list(r["center"]) for r in read("centers").collect()}, read("trees").toPandas(), {r["scope"]: r["size"] for r in read("sizes").collect()}, refs["anomaly"], refs["distance"], [axes["x"], axes["y"]], axes["mean"], read("baselines"))


def _shaped(train: DataFrame, k: int, seed: int, starts: int) -> RiskModel:
    """Scaler, segments, map and forests of the training rows: all that _scored() needs."""
    n = train.count()
    if n < 10 * k:
        raise ValueError(f"{n} training rows; {10 * k} are needed for {k} segments")
    scaler = scaler_of(train)
    scaled = written(train.select("case_id", *scaled_columns(scaler)), "scaled")
    centers = {i: [float(x) for x in c] for i, c in enumerate(segment_centers(scaled, FEATURE_COLUMNS, k, seed, starts))}
    mean, axes = plane(scaled, FEATURE_COLUMNS)
    near = written(assigned(scaled, FEATURE_COLUMNS, centers), "near")
    members = {r["cluster"]: r["n"] for r in near.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    trees = build_forest(near, members, seed).toPandas()  # the trees: a fixed number of at most 511 nodes each
    sizes = {-1: min(SAMPLE, n)} | {k: min(SAMPLE, m) for k, m in members.items() if m >= LEAST_SEGMENT}
    return RiskModel(scaler, centers, trees, sizes, None, None, axes, mean, None)


def fit(train: DataFrame, k: int = 5, seed: int = SEED, starts: int = STARTS) -> RiskModel:
    """Fit on training account-days (case_id, features)."""
    model = _shaped(train, k, seed, starts)
    model._refer(written(model._scored(train).select("case_id", *FEATURE_COLUMNS, "cluster", "anomaly", "center_distance"), "scored"))
    return model


def fit_score(features: DataFrame, last: date, k: int = 5, seed: int = SEED, starts: int = STARTS) -> tuple[RiskModel, DataFrame]:
    """fit() on the days up to last, and score() of all rows: each row goes through the forests once."""
    model = _shaped(train_rows(features, last), k, seed, starts)
    rows = written(model._scored(features), "scored")
    model._refer(train_rows(rows, last))
    return model, model._ranked(rows)


def _products(columns: list[str]) -> Callable:
    """Of a task's rows: their number, sums, and sums of products of each two columns, by place."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns) + 1, len(columns) + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), *(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "v"])

    return products


def plane(rows: DataFrame, columns: list[str]) -> tuple[list[float], list[list[float]]]:
    """(means, two axes of the largest variance, each with its largest loading positive), from one scan of sums and products."""
    d = len(columns) + 1
    total = np.zeros(d * d)
    for r in rows.select(*columns).mapInArrow(_products(columns), "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():  # a number of places
        total[r["place"]] = r["v"]
    total = total.reshape(d, d) / max(total[0], 1)
    mean = total[0, 1:]
    axes = np.linalg.eigh(total[1:, 1:] - np.outer(mean, mean))[1][:, ::-1][:, :2].T
    return [float(x) for x in mean], [[float(x) for x in a * np.sign(a[np.abs(a).argmax()])] for a in axes]
