"""Suffix-array dedup of long repeated byte strings across all texts, by longest-previous-factor arrays.

A byte string of min_bytes that starts at two places has the same least 32-byte fingerprint in both (a minimizer),
at the same distance from its start. So texts are cut into runs of consecutive starts with one such anchor, and only anchors
that occur twice go on. Equal runs are counted once (pre-aggregation by two 64-bit hashes, the anchor's and the run's).
The distinct runs of an anchor are laid end to end, in the order of their first copies; their starts are put in suffix order with
the lengths of common prefixes, compared byte by byte as far as min_bytes. Previous and next smaller positions
in that order give the longest previous factor of each start: where it reaches min_bytes, an earlier copy exists.

Every copy is removed, the first too: the same array over mirrored positions finds starts with a later copy. With keep_first
only the previous factors count, so the first copy stays.

An anchor of more than GROUP distinct runs is split until none is left, so no group is large: its starts are dealt by their
distance from the anchor into a few intervals, and within each by the bytes around the anchor that
all strings of the interval hold. Equal strings always meet again, and an interval of one distance is one string.

Defined cases: a null text is empty; texts below min_bytes are never changed; matches never cross texts; repeated
rows are copies of each other (with keep_first, rows equal in id, text and source stay alike: all are the first); of two
copies the one of the smaller doc_id (null first), then row hash, then place is the first; null ids, texts and sources
are told apart from any value; a very long text goes in overlapping pieces; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import _text as tx
from ledgerflow.llm._spark import in_arrow, row_key, saved, small

MIN_BYTES, GRAM = 200, 32
#: Bytes of runs put in suffix order at once; distinct runs of an anchor beyond which it is split; intervals of a split.
BLOCK, GROUP, WAYS = 1 << 19, 64, 4
#: Low bits of a fingerprint that give way to its place, so that the first of equal ones is the least; pieces have fewer places.
PLACE = np.uint64(20)
#: Rows up to which tables of runs and spans (lists of numbers for a text) are broadcast to the texts.
SPAN_ROWS = 10_000
IDS = ["k_id", "k_row"]


def _grams(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    w = np.ndarray((len(data),), np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each position on
    n = len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += w[k : k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, from running minima of blocks of w."""
    n = len(x) - w + 1
    y = np.concatenate((x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    head = np.minimum.accumulate(y, 1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def _anchors(h: np.ndarray, min_bytes: int) -> np.ndarray:
    """The place of the least fingerprint inside each string of min_bytes."""
    place = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    return (_sliding_min(place, min_bytes - GRAM + 1) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)


def _seg(raw: bytes, anchor: int) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=anchor)


def _runs(min_bytes: int) -> Callable:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tx.chunks(batch.column("text")):
                for lo in range(0, len(c.data), tx.PIECE):  # more than one piece only if a single text is longer
                    data = c.data[lo : lo + tx.PIECE + min_bytes - 1]
                    off = np.minimum(np.maximum(c.off - lo, 0), len(data))
                    if len(data) < min_bytes:
                        continue
                    h = _grams(data)
                    anchor = _anchors(h, min_bytes)
                    ok = np.zeros(len(anchor), bool)
                    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                        ok[a : max(a, b - min_bytes + 1)] = True
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    anchor = anchor[at]
                    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
                    p, n, a = at[new], np.diff(np.append(new, len(at))), anchor[new]
                    row, raw = c.doc_of(p + lo), memoryview(data.tobytes())
                    seg = np.fromiter((_seg(raw[s:e], d) for s, e, d in zip(p.tolist(), (p + n + min_bytes - 1).tolist(), (a - p).tolist(), strict=True)), np.uint64, len(p))
                    of = [batch.column(x).take(pa.array(c.first + row)) for x in IDS]
                    yield pa.RecordBatch.from_arrays(of + [pa.array(x) for x in (tx.signed(h[a]), tx.signed(seg), p + lo - c.off[row], n.astype(np.int32))], names=[*IDS, "key", "seg", "p", "n"])

    return runs


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at starts as far as depth bytes, ties by start; bytes that each shares with the one before it, at most depth)."""
    window = np.lib.stride_tricks.sliding_window_view(data, depth)[starts]
    order = np.argsort(window.view(f"S{depth}").ravel(), kind="stable")
    window = window[order]
    common = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        differ = window[1:] != window[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), depth)
    return order, common


def _nearest_smaller(place: np.ndarray, common: np.ndarray, enough: int) -> np.ndarray:
    """For each suffix, in suffix order, the bytes it shares with the nearest one before it of a smaller place; 0 if below enough.

    All suffixes look one back, and those that met a larger place go on from where that one stands: nothing between is smaller.
    """
    at, shared = np.arange(len(place)) - 1, common.copy()
    open_ = np.flatnonzero((at >= 0) & (shared >= enough))
    open_ = open_[place[at[open_]] > place[open_]]
    while len(open_):
        via = at[open_]
        further, less = at[via], np.minimum(shared[open_], shared[via])
        at[open_], shared[open_] = further, less
        open_ = open_[(further >= 0) & (less >= enough)]
        open_ = open_[place[at[open_]] > place[open_]]
    return np.where((at >= 0) & (shared >= enough), shared, 0)


def previous_factors(place: np.ndarray, common: np.ndarray, enough: int) -> np.ndarray:
    """The longest-previous-factor array in suffix order: bytes shared with a suffix of smaller place, as far as common reaches; 0 if below enough."""
    back = np.concatenate((np.zeros(1, common.dtype), common[:0:-1])) if len(common) else common
    return np.maximum(_nearest_smaller(place, common, enough), _nearest_smaller(place[::-1], back, enough)[::-1])


def _settle(runs: list[tuple], min_bytes: int, keep_first: bool) -> list[tuple[int, int, int, int]]:
    """(key0, seg0, first, last) of the stretches of starts that also occur elsewhere (or: earlier) in these runs (key, key0, seg0, s, n, bytes)."""
    n = np.array([r[4] for r in runs])
    base = np.concatenate(([0], np.cumsum([len(r[5]) for r in runs])))[:-1]
    data = np.frombuffer(b"".join(r[5] for r in runs), np.uint8)
    run = np.repeat(np.arange(len(runs)), n)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    starts = base[run] + inner
    order, common = suffix_order(data, starts, min_bytes)
    place = starts[order]
    copied = previous_factors(place, common, min_bytes) >= min_bytes
    if not keep_first:
        copied |= previous_factors(-place, common, min_bytes) >= min_bytes
    at = np.sort(order[copied])
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]]))))
    last = np.append(new[1:], len(at)) - 1
    return [(*runs[r][1:3], runs[r][3] + s, runs[r][3] + e) for r, s, e in zip(run[at[new]].tolist(), inner[at[new]].tolist(), inner[at[last]].tolist(), strict=True)]


MARK = "key0 bigint, seg0 bigint, s int, e int"


def _matches(min_bytes: int, keep_first: bool) -> Callable:
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, then in the order of the texts; a block ends between keys."""
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if held and (found := _settle(held, min_bytes, keep_first)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key0", "seg0", "s", "e"])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("key", "key0", "seg0", "s", "n", "run")), strict=True):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield from out()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        yield from out()

    return matches


PART = "k_id bigint, k_row bigint, p bigint, key bigint, seg bigint, key0 bigint, seg0 bigint, s int, n int, lo int, hi int, run binary"


def _split(min_bytes: int) -> Callable:
    """Runs in WAYS parts, by the distance of their starts from the anchor; a part's key adds the bytes that all strings of its interval hold."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw = r["run"]
                anchor = int(_anchors(_grams(np.frombuffer(raw[:min_bytes], np.uint8)), min_bytes)[0])
                cuts = [r["lo"] + (r["hi"] - r["lo"]) * k // WAYS for k in range(WAYS + 1)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    first, end = max(0, anchor - hi + 1), min(r["n"], anchor - lo + 1)
                    if lo == hi or first >= end:
                        continue
                    part = raw[first : end + min_bytes - 1]
                    key = xxhash.xxh3_64_intdigest(raw[anchor - lo : anchor + min_bytes + 1 - hi], seed=(r["key"] * 1_000_003 + lo * 1_009 + hi) & (1 << 64) - 1)
                    seg = _seg(part, anchor - first)
                    out.append((r["k_id"], r["k_row"], r["p"] + first, key - (1 << 63), seg - (1 << 63), r["key0"], r["seg0"], r["s"] + first, end - first, lo, hi, part))
            names = [x.split()[0] for x in PART.split(", ")]
            kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[t.split()[1]]) for x, t in zip(cols, PART.split(", "), strict=True)], names=names)

    return split


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _grouped(runs: DataFrame, seg: str = "seg") -> tuple[DataFrame, DataFrame]:
    """(runs whose key occurs twice; key, seg, copies and rep, the first row, of each distinct run with segs, their number under the key).

    Counts are written before the rows join them, so that both sides of each join are plain tables and a hot key's rows can be split.
    """
    twice = saved(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    shared = saved(runs.join(small(twice), "key"))
    distinct = saved(shared.groupBy("key", seg).agg(F.count("*").alias("copies"), F.min(F.struct(*IDS, "p")).alias("rep"), F.first("n").alias("n")))
    keys = saved(distinct.groupBy("key").agg(F.count("*").alias("segs")).where("segs > 1"))
    return shared, saved(distinct.join(small(keys), "key", "left").withColumn("segs", F.coalesce("segs", F.lit(1))))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts with the keys k_id and k_row, (k_id, k_row, spans): stretches of starts [a, b] of strings of min_bytes that occur more than once).

    With keep_first only those that occur earlier, in the order of doc_id (null first), content hash and place.
    """
    texts = _texts(docs)
    runs = saved(in_arrow(texts.select(*IDS, "text"), _runs(min_bytes), "k_id bigint, k_row bigint, key bigint, seg bigint, p bigint, n int"))
    shared, segs = _grouped(runs)

    # the bytes of the distinct runs of anchors with several
    asked = segs.where("segs > 1").groupBy("rep.k_id", "rep.k_row").agg(F.collect_list(F.struct("key", "seg", "rep.p", "n", "segs")).alias("runs"))
    cut = texts.join(small(saved(asked), SPAN_ROWS), IDS).select(*IDS, F.col("text").cast("binary").alias("raw"), F.explode("runs").alias("r"))
    run = F.expr(f"substring(raw, cast(r.p + 1 as int), r.n + {min_bytes - 1})")
    cut = saved(cut.select(*IDS, "r.p", "r.key", "r.seg", F.col("r.key").alias("key0"), F.col("r.seg").alias("seg0"), F.lit(0).alias("s"), "r.n", F.lit(0).alias("lo"), F.lit(min_bytes - GRAM + 1).alias("hi"), run.alias("run"), "r.segs").dropDuplicates(["key", "seg"]))

    settled, marks = [cut.where(F.col("segs") <= GROUP)], []
    hot = cut.where(F.col("segs") > GROUP)
    while not hot.isEmpty():  # each turn leaves a fourth of an interval: at most four turns for 200 bytes
        parts = saved(in_arrow(hot.drop("segs", "seg"), _split(min_bytes), PART))
        twice, again = _grouped(parts)
        both = saved(twice.drop("n").join(small(again.select("key", "seg", "copies", "rep", "segs", "n")), ["key", "seg"]))
        first = (F.col("k_id") == F.col("rep.k_id")) & (F.col("k_row") == F.col("rep.k_row")) & (F.col("p") == F.col("rep.p"))
        marks.append(both.where((F.col("copies") > 1) & (~first if keep_first else F.lit(True))).select("key0", "seg0", "s", (F.col("s") + F.col("n") - 1).alias("e")))
        left = saved(both.where(first & (F.col("segs") > 1)).select(*cut.columns))
        settled.append(left.where(F.col("segs") <= GROUP))
        hot = left.where((F.col("segs") > GROUP) & (F.col("hi") - F.col("lo") > 1))
    ordered = _all(settled).repartition("key").sortWithinPartitions("key", *IDS, "p").select("key", "key0", "seg0", "s", "n", "run")
    found = _all([in_arrow(ordered, _matches(min_bytes, keep_first), MARK), *marks]).select(F.col("key0").alias("key"), F.col("seg0").alias("seg"), "s", "e")
    span = F.struct((F.col("p") + F.col("s")).alias("a"), (F.col("p") + F.col("e")).alias("b"))
    if keep_first:  # the first copy of a run loses what its marks say, every other copy all of it
        firsts = segs.select("key", "seg", "rep.k_id", "rep.k_row", "rep.p").join(found, ["key", "seg"])
        copies = shared.join(saved(segs.where("copies > 1").select("key", "seg", "rep")), ["key", "seg"]).where("k_id <> rep.k_id or k_row <> rep.k_row or p <> rep.p")
        marked = firsts.select(*IDS, span.alias("x")).unionByName(copies.select(*IDS, F.struct(F.col("p").alias("a"), (F.col("p") + F.col("n") - 1).alias("b")).alias("x")))
    else:
        equal = segs.where("copies > 1").select("key", "seg", F.lit(0).alias("s"), (F.col("n") - 1).alias("e"))
        every = saved(found.join(equal.select("key", "seg"), ["key", "seg"], "left_anti").unionByName(equal))
        marked = shared.join(every, ["key", "seg"]).select(*IDS, span.alias("x"))
    return texts, marked.groupBy(*IDS).agg(F.collect_set("x").alias("spans"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _gone(size: int, spans: list[dict] | None, min_bytes: int) -> np.ndarray:
    if not spans:
        return np.zeros(size, bool)
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, [s["a"] for s in spans], 1)
    np.add.at(edge, [s["b"] + min_bytes for s in spans], -1)
    return np.cumsum(edge)[:size] > 0


def _digest(min_bytes: int) -> Callable:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch.column("spans")
            for c in tx.chunks(batch.column("text")):
                for k in range(c.n):
                    data = c.data[c.off[k] : c.off[k + 1]]
                    gone = _gone(len(data), spans[c.first + k].as_py(), min_bytes)
                    rows.append((len(data), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return digest


def _rest(min_bytes: int) -> Callable:
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            spans = batch.column("spans")
            for c in tx.chunks(batch.column("text")):
                for k in range(c.n):
                    data = c.data[c.off[k] : c.off[k + 1]]
                    kept.append(data[~_gone(len(data), spans[c.first + k].as_py(), min_bytes)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return rest


def _with_spans(docs: DataFrame, min_bytes: int, keep_first: bool) -> DataFrame:
    texts, spans = repeated_spans(docs, min_bytes, keep_first)
    return texts.join(small(saved(spans), SPAN_ROWS), IDS, "left").select("doc_id", "text", "spans")


def kept_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = True) -> DataFrame:
    """doc_id and kept, the bytes that stay of each row of docs (binary: a removed run may begin or end inside a character)."""
    return in_arrow(_with_spans(docs, min_bytes, keep_first), _rest(min_bytes), "doc_id bigint, kept binary")


def removed_digests(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay, for each row of docs."""
    return in_arrow(_with_spans(docs, min_bytes, keep_first), _digest(min_bytes), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
