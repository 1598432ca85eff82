"""Near-duplicate vectors through a robust-pruned flat graph.

Equal vectors become one class. Classes are dealt to cluster shards: home is the nearest centroid, the next
nearest holds a second copy, so shards overlap; each class also visits further near shards as a query. In each
shard a graph is built (nearest candidates, robust pruning), and the adjacency lists of a class from all its
shards are united. Then each tile of a shard is searched for its visitors: greedily from the medoid (and from the
query's own node where it has one), and once inside the range by expanding every node in range until none is
new. A link is counted only where the double-precision cosine reaches the limit, and only in the other class's home
shard, so nothing counts twice and no pairs are written: a query hands on its count, and one node of each
local component that it touches.

recall is audited by brute force until AUDIT queries with true links are seen, or the query set ends; below TARGET the
visits are doubled, and where no query has a true link recall is logged as unmeasured.
Shards above BLOCK classes are split into blocks, all of which are searched: a hot cluster is never one task.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; each
length is a group of its own; repeated rows count as vectors each; a null vec_id keeps a null component; equally near
candidates and centroids are taken in the order of their places; very long vectors take fewer rows in the samples; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm._graph import components
from ledgerflow.llm._spark import in_arrow, saved, small

log = logging.getLogger(__name__)

LIMIT = 0.9
#: Vectors for each shard on average; most shards; sample for the centroids (rows, and components in all).
PER_SHARD, MOST_SHARDS, SAMPLE, SAMPLE_NUMBERS = 500, 4096, 20_000, 16_000_000
#: Shards visited by a query; candidates, degree and slack of robust pruning; beam of the greedy search.
VISITS, CANDIDATES, DEGREE, ALPHA, BEAM, STEP = 6, 64, 24, 1.2, 48, 4
#: Members of a tile, visitors of a tile, queries with true links of the recall audit, and the recall aimed at.
BLOCK, VISITORS, AUDIT, TARGET = 4_000, 8_000, 256, 0.99
#: Queries that walk a tile in step, times its members (about 11 bytes each).
WALKS = 500_000
#: Audited first: the vec_ids divisible by this; queries tried at least before recall stays unmeasured or measured on fewer.
EVERY, LEAST_QUERIES = 50, 4_096


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """The neighbours of each row: of its nearest candidates those that no nearer neighbour is alpha times closer to."""
    m = len(x)
    out: list[np.ndarray] = []
    width = min(CANDIDATES, m - 1)
    if width < 1:
        return [np.zeros(0, np.int64)] * m
    size = max(1, min(256, 4_000_000 // (width * x.shape[1]), 4_000_000 // m))
    for lo in range(0, m, size):
        s = x[lo : lo + size] @ x.T
        rows = np.arange(len(s))
        s[rows, rows + lo] = -np.inf
        near = np.argpartition(-s, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        far = 2 - 2 * np.take_along_axis(s, near, 1)
        between = 2 - 2 * x[near] @ x[near].transpose(0, 2, 1)
        alive, kept = np.ones_like(near, bool), np.zeros_like(near, bool)
        for _ in range(degree):
            any_, j = alive.any(1), alive.argmax(1)
            if not any_.any():
                break
            kept[rows[any_], j[any_]] = True
            alive &= alpha * alpha * between[rows, j] > far
            alive[rows, j] = False
        out += [n[k] for n, k in zip(near, kept, strict=True)]
    return out


def _csr(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0], np.cumsum([len(a) for a in lists]))), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)


def _neighbours(off: np.ndarray, to: np.ndarray, nodes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """base[i] + neighbour for each edge of each nodes[i]."""
    size = off[nodes + 1] - off[nodes]
    ends = np.cumsum(size)
    return to[np.repeat(off[nodes] - (ends - size), size) + np.arange(ends[-1])] + np.repeat(base, size)


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest values of each row, in any order."""
    return np.argpartition(-values, k - 1, axis=1)[:, :k] if values.shape[1] > k else np.broadcast_to(np.arange(values.shape[1]), values.shape)


def range_search(q: np.ndarray, x: np.ndarray, off: np.ndarray, to: np.ndarray, entry: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the nodes found with cosine >= limit, by greedy search with a beam and then by expanding all nodes in range.

    The queries walk in step: each turn expands, for all of them at once, the best open nodes of each beam and every new
    node in range. entry holds the nodes where each query starts; a negative one is none.
    """
    n, m = len(q), len(x)
    score, done, unseen, met = np.full(n * m, -np.inf), np.zeros(n * m, bool), np.ones(n * m, bool), np.zeros(n * m, bool)
    beam, beam_score = np.zeros((n, BEAM), np.int64), np.full((n, BEAM), -np.inf)
    step = max(1, 1_000_000 // x.shape[1])
    row, col = np.nonzero(entry >= 0)
    new = np.unique(row * m + entry[row, col])
    while True:
        if len(new):
            unseen[new] = False
            row, node = np.divmod(new, m)
            for lo in range(0, len(new), step):
                score[new[lo : lo + step]] = np.einsum("ij,ij->i", q[row[lo : lo + step]], x[node[lo : lo + step]])
            # the new nodes meet the beams of their queries, a line for each query
            first = np.flatnonzero(np.diff(row, prepend=-1))
            size = np.diff(first, append=len(row))
            line, at = np.repeat(np.arange(len(first)), size), np.arange(len(row)) - np.repeat(first, size)
            fresh, fresh_score = np.zeros((len(first), size.max()), np.int64), np.full((len(first), size.max()), -np.inf)
            fresh[line, at], fresh_score[line, at] = node, score[new]
            active = row[first]
            fresh, fresh_score = np.concatenate((beam[active], fresh), 1), np.concatenate((beam_score[active], fresh_score), 1)
            top = _best(fresh_score, BEAM)
            beam[active], beam_score[active] = np.take_along_axis(fresh, top, 1), np.take_along_axis(fresh_score, top, 1)
        flat = np.arange(n)[:, None] * m + beam
        left = np.where(done[flat], -np.inf, beam_score)
        top = _best(left, STEP)
        go = np.take_along_axis(flat, top, 1)[np.take_along_axis(left, top, 1) > -np.inf]
        go = np.unique(np.concatenate((go, new[score[new] >= limit])))
        if not len(go):
            return np.divmod(np.flatnonzero(score >= limit), m)
        done[go] = True
        node = go % m
        new = _neighbours(off, to, node, go - node)
        met[new[unseen[new]]] = True
        new = np.flatnonzero(met)
        met[new] = False


def _local(x: np.ndarray, off: np.ndarray, to: np.ndarray, limit: float) -> np.ndarray:
    """A label for each node: the least node it reaches over edges with cosine >= limit."""
    a = np.repeat(np.arange(len(x)), np.diff(off))
    near = np.einsum("ij,ij->i", x[a], x[to]) >= limit
    a, b = a[near], to[near]
    label = np.arange(len(x))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _assign(c: np.ndarray, visits: int) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            s = unit(np.stack(batch.column("v").to_numpy(zero_copy_only=False))) @ c.T
            width = min(visits, len(c))
            near = np.argpartition(-s, width - 1, axis=1)[:, :width]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
            for k in range(width):
                yield pa.RecordBatch.from_arrays([pa.array(near[:, k].astype(np.int32)), pa.array(np.full(len(batch), k, np.int32)), *(batch.column(x) for x in ("key", "n", "v"))], names=["shard", "place", "key", "n", "v"])

    return assign


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key", ignore_index=True)
    key = pdf["key"].to_numpy(np.int64)
    return pd.DataFrame({"key": key, "to": [key[a] for a in robust_prune(unit(np.stack(pdf["v"])))]})


def _search(limit: float, whole: bool = False) -> Callable:
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf[pdf["member"]].sort_values("key", ignore_index=True)
        visitors = pdf[~pdf["member"]]
        if not len(members) or not len(visitors):
            return pd.DataFrame({"key": [], "found": [], "touched": []})
        key = members["key"].to_numpy(np.int64)
        x = unit(np.stack(members["v"]))
        lists = []
        for a in members["to"]:
            a = np.asarray(a, np.int64)
            at = np.minimum(np.searchsorted(key, a), len(key) - 1)
            lists.append(at[key[at] == a])
        off, to = _csr(lists)
        back = np.repeat(np.arange(len(key)), np.diff(off))  # edges count both ways
        pairs = np.unique(np.concatenate((back * len(key) + to, to * len(key) + back)))
        off, to = np.searchsorted(pairs // len(key), np.arange(len(key) + 1)), pairs % len(key)
        home, weight = members["home"].to_numpy(bool), members["n"].to_numpy(np.int64)
        label = _local(x, off, to, limit)
        medoid = int((x @ x.sum(0)).argmax())
        found, touched = [], []
        names, size = visitors["key"].to_numpy(np.int64), max(1, min(512, WALKS // len(x)))
        for lo in range(0, len(names), size):
            part = names[lo : lo + size]
            own = np.minimum(np.searchsorted(key, part), len(key) - 1)
            entry = np.stack((np.full(len(part), medoid), np.where(key[own] == part, own, -1)), 1)
            q = unit(np.stack(visitors["v"].iloc[lo : lo + size]))
            of, hit = np.nonzero(q @ x.T >= limit) if whole else range_search(q, x, off, to, entry, limit)
            other = key[hit] != part[of]
            of, hit = of[other], hit[other]
            count = np.zeros(len(part), np.int64)
            np.add.at(count, of, np.where(home[hit], weight[hit], 0))
            met, node = np.divmod(np.unique(of * len(x) + label[hit]), len(x))
            found.append(count)
            touched += np.split(key[node], np.searchsorted(met, np.arange(1, len(part))))
        return pd.DataFrame({"key": names, "found": np.concatenate(found), "touched": touched})

    return search


def classes(rows: DataFrame) -> DataFrame:
    """key, n (vectors), least (vec_id), v of the distinct vectors that can link."""
    fine = rows.where(F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"))
    return fine.groupBy(F.xxhash64("v").alias("key")).agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))


def search_once(found: DataFrame, c: np.ndarray, visits: int, limit: float, visitors: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """key, found (linked vectors of other classes), touched (keys of one node of each local component met) for each visitor and tile; visitors: all classes, or others (key, n, v). whole: compare with every member of a tile instead of walking its graph."""
    kinds = "shard int, place int, key bigint, n bigint, v array<double>"
    dealt = saved(in_arrow(found, _assign(c, visits if visitors is None else 2), kinds))
    asks = dealt if visitors is None else saved(in_arrow(visitors, _assign(c, visits), kinds))
    # one row a shard, at most MOST_SHARDS
    blocks = dealt.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("place") < 2) / BLOCK)).cast("int").alias("blocks"))
    plan = F.broadcast(saved(blocks.join(asks.groupBy("shard").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("chunks")), "shard")))
    members = dealt.where("place < 2").join(plan, "shard").withColumn("block", F.pmod(F.col("key"), F.col("blocks")).cast("int"))
    lists = members.select("shard", "block", "key", "v").groupBy("shard", "block").applyInPandas(_build, "key bigint, to array<bigint>")
    graph = saved(lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")))
    nodes = members.join(graph, "key").select("shard", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("member"), (F.col("place") == 0).alias("home"), "key", "n", "v", "to")
    asked = asks.join(plan, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("member"), F.lit(False).alias("home"), "key", "n", "v", F.array().cast("array<bigint>").alias("to"))
    return saved(nodes.unionByName(asked).groupBy("shard", "block", "chunk").applyInPandas(_search(limit, whole), "key bigint, found bigint, touched array<bigint>"))


class Audit(NamedTuple):
    recall: float | None  # mean over the queries with true links; None: no query had one
    seen: int  # queries with true links
    tried: int


def audit(found: DataFrame, counted: DataFrame, limit: float, wanted: int = AUDIT) -> Audit:
    """Recall of counted (key, found) by brute force against all classes, for blocks of queries until so many have true links.

    Queries are the classes whose least vec_id is divisible by EVERY, then others up to LEAST_QUERIES in all. Each query counts once, whatever its number of links.
    """
    first = found.withColumn("later", F.coalesce(F.col("least") % EVERY != 0, F.lit(True)))
    total = max(LEAST_QUERIES, first.where("not later").count())
    order = Window.orderBy("later", F.xxhash64("key"), "key")
    queries = saved(first.orderBy("later", F.xxhash64("key"), "key").limit(total).select("key", "v", F.row_number().over(order).alias("at")))
    width = len(queries.select("v").first()["v"])
    recall, seen, tried, size = 0.0, 0, 0, 256
    while seen < wanted:
        block = queries.where((F.col("at") > tried) & (F.col("at") <= tried + size)).select("key", "v").collect()
        if not block:
            break
        q, names = unit(np.array([r["v"] for r in block])), np.array([r["key"] for r in block])
        truth = in_arrow(found.select("key", "n", "v"), _truth(q, names, limit), "key bigint, truth bigint").groupBy("key").agg(F.sum("truth").alias("truth")).where("truth > 0")
        got = truth.join(counted, "key", "left").agg(F.count("*").alias("c"), F.sum(F.least("truth", F.coalesce("found", F.lit(0))) / F.col("truth")).alias("r")).first()
        recall, seen, tried = recall + (got["r"] or 0.0), seen + got["c"], tried + len(block)
        size = min(4 * size, 4096, max(256, 2_000_000 // width))
    return Audit(recall / seen if seen else None, seen, tried)


def _truth(q: np.ndarray, names: np.ndarray, limit: float) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q), np.int64)
        step = max(1, 4_000_000 // len(q))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                near = unit(np.stack(part.column("v").to_numpy(zero_copy_only=False))) @ q.T >= limit
                near &= np.asarray(part.column("key"))[:, None] != names[None, :]
                total += np.asarray(part.column("n")) @ near
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["key", "truth"])

    return count


def planted_recall(found: DataFrame, c: np.ndarray, visits: int, limit: float) -> float:
    """Recall over AUDIT made-up queries: classes turned by a known angle in a random direction, searched like the others. For tables whose own queries have no links."""
    rows = found.orderBy(F.xxhash64("key", F.lit("planted")), "key").limit(AUDIT).select("key", "v").collect()
    x, rng = unit(np.array([r["v"] for r in rows])), np.random.default_rng(11)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    near = (1 + limit) / 2 if x.shape[1] > 1 else 1.0
    q = near * x + np.sqrt(1 - near * near) * aside / np.where(norm > 0, norm, 1)
    names = [r["key"] ^ 0x5DEECE66D for r in rows]
    asks = found.sparkSession.createDataFrame([(k, 1, [float(y) for y in v]) for k, v in zip(names, q, strict=True)], "key bigint, n bigint, v array<double>")
    counted = search_once(found, c, visits, limit, asks).groupBy("key").agg(F.sum("found").alias("found"))
    truth = in_arrow(found.select("key", "n", "v"), _truth(unit(q), np.array(names), limit), "key bigint, truth bigint").groupBy("key").agg(F.sum("truth").alias("truth"))
    return truth.where("truth > 0").join(counted, "key", "left").agg(F.avg(F.least("truth", F.coalesce("found", F.lit(0))) / F.col("truth"))).first()[0]


def _groups(found: DataFrame, limit: float, visits: int) -> DataFrame:
    """key, n_links, component_id of the classes (key, n, least, v) of one vector length."""
    n = found.count()
    width = len(found.select("v").first()["v"])
    bounded = min(SAMPLE, max(1000, SAMPLE_NUMBERS // width))
    sample = unit(np.array([r["v"] for r in found.select("v", "key").orderBy(F.xxhash64("key"), "key").limit(bounded).select("v").collect()]))
    c = centroids(sample, max(1, min(n // PER_SHARD, MOST_SHARDS, len(sample) // 4)))
    whole = False
    while True:
        hits = search_once(found, c, visits, limit, whole=whole)
        counted = saved(hits.groupBy("key").agg(F.sum("found").alias("found")))
        if whole:  # every class was compared with every other
            break
        recall, seen, tried = audit(found, counted, limit)
        if recall is None:
            if tried >= n:  # all classes were compared with all: there are no links
                break
            recall = planted_recall(found, c, visits, limit)
            log.info("recall %.4f over made-up queries, as none of %d has a true link", recall, tried)
        else:
            log.info("recall %.4f over %d queries with true links, of %d", recall, seen, tried)
        if recall >= TARGET:
            break
        whole = visits >= len(c)
        log.warning("recall %.3f with %d visits: %s", recall, visits, "comparing with all" if whole else "doubling them")
        visits = min(2 * visits, len(c))
    ids = found.select("key", "least")
    far = hits.select("key", F.explode("touched").alias("other")).distinct().join(ids, "key").select(F.col("least").alias("a"), "other")
    links = far.join(ids.select(F.col("key").alias("other"), F.col("least").alias("b")), "other").select("a", "b")
    group = components(links)
    named = found.select("key", "n", "least").join(counted, "key").join(small(group), F.col("least") == F.col("node"), "left")
    return saved(named.select("key", (F.col("n") - 1 + F.col("found")).alias("n_links"), F.coalesce("component", "least").alias("component_id")))


def linked_vectors(table: DataFrame, limit: float = LIMIT, visits: int = VISITS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of table (vec_id, embedding)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    found = saved(classes(rows))
    lengths = [r["d"] for r in found.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = [_groups(found if len(lengths) == 1 else saved(found.where(F.size("v") == d)), limit, visits) for d in lengths]
    named = reduce(DataFrame.unionByName, parts)
    keyed = rows.select("vec_id", F.when(F.expr("v is not null and size(v) > 0"), F.xxhash64("v")).alias("key"))
    out = keyed.join(small(named), "key", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNull(), None).otherwise(own).alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
