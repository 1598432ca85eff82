"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Equal shingle sets become one class. The classes whose sets share one of their smallest shingle hashes,
and whose sizes allow the similarity, meet in a tile (hash, size band); bands are a factor 1/threshold
wide, so two similar sets are in the same band or in neighbouring ones. A parity bitmap of 1024 bits for each
class bounds the overlap from above: bits that differ come from shingles that only one set has. Pairs
that pass are checked exactly on the sorted arrays of 64-bit shingle hashes.

Candidates: two sets with Jaccard >= 0.8 share at least 3 of their 20 smallest hashes, for sets of up to 20
shingles always, for larger ones but for a chance of 4e-11 a pair (P[Binomial(20, 0.8) <= 2]); there is no cap.
Groups of near copies are first linked to one leader for each tile; the pairs of a tile are looked at
only where its members are not yet in one component, so a large group costs links in proportion to its size. The
members of tiles larger than TILE meet by their rarest shingles instead (exact, no chance of a miss), so a passage that very many unlike
documents hold brings no two of them together.
Every pair, a leader's too, passes the bitmap bound before its arrays are fetched.

Defined cases: null or blank texts have no shingles, n_shingles 0, and are a component of their own; a text of
fewer than five words is one shingle; repeated rows are one class; a null doc_id stays null, and is no component's
smallest id unless all of its ids are null; of equally small candidates for leader or representative the
least hash or row key wins; a very long text is hashed in pieces and its set kept whole (about 8 bytes a
word); an empty table gives no rows; other columns are not read, and near_dedup() hands them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm import _text as tx
from ledgerflow.llm._graph import components
from ledgerflow.llm._spark import in_arrow, row_key, saved, small, whole, without

THRESHOLD, WORDS = 80, 5
SMALLEST, SHARED, LANES = 20, 3, 16
BITS = 64 * LANES
#: Further rounds of leaders (each costs a pass over the open tiles) while the pairs of open tiles exceed OPEN a member, and leaders a tile in each.
ROUNDS, OPEN, LEADERS = 2, 8, 8
#: Members of a tile that are still joined pair by pair; those of larger ones meet by their rarest shingles.
TILE = 200
#: Counters of the sketch that tells rare shingles from frequent ones (8 MB in each task), the counters of a row of it, and how far they count.
BUCKETS, RANGE, MOST = 1 << 22, 1 << 14, (1 << 16) - 1


def _sets(c: tx.Chunk) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = tx.LOWER[c.data]
    row, start, end = c.words(~tx.SPACE[data])
    words = tx.range_hashes(data, start, end)
    win, at = tx.windows(words, row, WORDS)
    win_of = np.searchsorted(row[at], np.arange(c.n + 1))
    word_of = np.searchsorted(row, np.arange(c.n + 1))
    for k in range(c.n):
        if win_of[k + 1] > win_of[k]:
            yield np.unique(win[win_of[k] : win_of[k + 1]])
        elif word_of[k + 1] > word_of[k]:
            lo, hi = word_of[k : k + 2]
            yield tx.mix(tx.sequence_hash(words[lo:hi], np.array([0]), np.array([hi - lo])))
        else:
            yield np.zeros(0, np.uint64)


def _class_of(s: np.ndarray) -> int:
    return int(tx.mix(np.array([tx.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in tx.chunks(batch.column("text")):
            part, sets = batch.slice(c.first, c.n), list(_sets(c))
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(c.n), size)
            odd = np.bincount(row * BITS + (flat >> np.uint64(20)).astype(np.int64) % BITS, minlength=c.n * BITS) % 2
            lanes = np.packbits(odd.astype(np.uint8)).view(np.int64)
            least = [s[:SMALLEST].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(x) for x in ("k_id", "k_row", "doc_id")]
                + [
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.minimum(size, SMALLEST)))).astype(np.int32)), pa.array(np.concatenate(least), pa.int64())),
                    pa.ListArray.from_arrays(pa.array((np.arange(c.n + 1) * LANES).astype(np.int32)), pa.array(lanes)),
                ],
                names=["k_id", "k_row", "doc_id", "node", "n", "least", "lanes"],
            )


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in tx.chunks(batch.column("text")):
            sets = [s for s in _sets(c) if len(s)]
            if sets:
                off = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets]), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets reach the threshold, from both sorted arrays."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        ok = np.zeros(len(batch), bool)
        for i in range(len(batch)):
            u, v = (np.asarray(z[i].values).view(np.uint64) for z in (x, y))
            both = int((np.diff(np.sort(np.concatenate((u, v)))) == 0).sum())
            ok[i] = 100 * both >= THRESHOLD * (len(u) + len(v) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])


def _keyed(docs: DataFrame) -> DataFrame:
    k_id, k_row = row_key()
    return docs.select(k_id, k_row, F.col("doc_id").cast("long").alias("doc_id"), "text")


def _fits(a: str, b: str):
    return (100 * F.col(a) >= THRESHOLD * F.col(b)) & (100 * F.col(b) >= THRESHOLD * F.col(a))


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (tx.mix(shingles.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the task's sets fall into each bucket: for each range of buckets a row with those that are in use."""
    total = np.zeros(BUCKETS, np.uint16)
    for batch in batches:
        at, n = np.unique(_buckets(batch.column("shingles").flatten().to_numpy()), return_counts=True)
        total[at] = np.minimum(total[at] + n, MOST)
    at = np.flatnonzero(total)
    ranges, first = np.unique(at // RANGE, return_index=True)
    off = pa.array(np.append(first, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in ((at % RANGE).astype(np.int16), total[at].astype(np.int32))]
    yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), *lists], names=["range", "place", "n"])


def _met(parts: pa.Table) -> pa.Table:
    """The tasks' rows of one range as one: its counters."""
    place, n = (parts.column(c).combine_chunks().flatten().to_numpy() for c in ("place", "n"))
    total = np.minimum(np.bincount(place, n, RANGE), MOST).astype(np.uint16)
    return pa.table({"range": parts.column("range").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})


def _prefixes(held: np.ndarray) -> Callable:
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, common = [np.zeros(0, np.int64)], []
            for row in batch.column("shingles"):
                s = row.values.to_numpy()
                n = held[_buckets(s)]
                at = np.lexsort((s, n))[: len(s) * (100 - THRESHOLD) // 100 + 1]
                first.append(s[at[n[at] > 1]])
                common.append(int((n > 1).sum()))
            of = np.repeat(np.arange(len(common)), [len(x) for x in first[1:]])
            rows = batch.select([name for name in batch.schema.names if name != "shingles"]).take(pa.array(of))
            yield rows.append_column("s", pa.array(np.concatenate(first))).append_column("common", pa.array(np.array(common, np.int64)[of]))

    return prefixes


def _rarest(sets: DataFrame) -> DataFrame:
    """The rows of sets, with s in place of shingles: of the rarest shingles of each set as many as leave less than the threshold of the set, a row each, but none for
    those that no other set holds; and common, how many of the set's shingles others may hold.

    Two similar sets share one of the rarest: the order (shingles in the bucket, shingle) is the same for all, and the rest of either set is too small
    to hold what they share. A shingle alone in its bucket is in no other set, so nothing meets by it. The buckets are of a fixed number; where many
    shingles meet in one the order says less, but stays an order, and fewer are known to be alone.
    """
    held = np.zeros(BUCKETS, np.uint16)
    parts = in_arrow(sets.select("shingles"), _held, "range int, place array<smallint>, n array<int>")
    for r in parts.groupBy("range").applyInArrow(_met, "range int, n binary").collect():  # BUCKETS / RANGE rows at most
        held[r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(r["n"], np.uint16)
    kinds = T.StructType([f for f in sets.schema.fields if f.name != "shingles"] + [T.StructField("s", T.LongType()), T.StructField("common", T.LongType())])
    return in_arrow(sets, _prefixes(held), kinds)


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: k_id, k_row, doc_id, node, n; node -> component of the linked classes)."""
    rows = saved(in_arrow(_keyed(docs), _sketch, "k_id bigint, k_row bigint, doc_id bigint, node bigint, n bigint, least array<bigint>, lanes array<bigint>"))
    full = rows.where("node is not null")
    every = saved(full.select("node", "n", F.explode("least").alias("h")).distinct())  # copies meet here, before any join
    shared = saved(every.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("h"))
    held = saved(every.join(small(shared), "h"))
    active = saved(held.groupBy("node").agg(F.count("*").alias("shares")).where(F.col("shares") >= SHARED).select("node"))
    held = held.join(small(active), "node", "left_semi")
    classes = saved(full.join(small(active), "node", "left_semi").groupBy("node").agg(F.min(F.struct("k_id", "k_row")).alias("rep"), F.first("n").alias("n"), F.first("lanes").alias("lanes")))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26))).cast("int")
    tiles = held.select("h", "node", "n", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))).alias("t")).select("h", "t.band", "t.own", "node", "n")
    tiles = saved(tiles)

    reps = saved(classes.select("rep.k_id", "rep.k_row"))
    arrays = saved(in_arrow(_keyed(docs).join(small(reps), ["k_id", "k_row"], "left_semi").select("text"), _arrays, "node bigint, shingles array<bigint>").dropDuplicates(["node"]))

    bits = saved(classes.select("node", "n", *(F.col("lanes")[i].alias(f"w{i}") for i in range(LANES))))
    # |A & B| <= (total - differ) / 2, and Jaccard >= t asks for |A & B| >= total * t / (1 + t)
    differ = sum((F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(1, LANES)), F.bit_count(F.col("a.w0").bitwiseXOR(F.col("b.w0"))))
    total = F.col("a.n") + F.col("b.n")
    bound = (100 + THRESHOLD) * (total - differ) >= 2 * THRESHOLD * total

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose bitmaps allow the threshold."""
        side = small(bits, 20_000)
        return pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(side.alias("a"), F.col("pa") == F.col("a.node")).join(side.alias("b"), F.col("pb") == F.col("b.node")).where(bound).select(F.col("pa").alias("a"), F.col("pb").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = arrays.select(F.col("node").alias("a"), F.col("shingles").alias("x")), arrays.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return saved(in_arrow(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y"), _linked, "a bigint, b bigint"))

    # leaders: in each tile its smallest class; a pair is tried when enough tiles propose it
    leader = tiles.groupBy("h", "band").agg(F.min(F.struct(F.col("node"), F.col("n"))).alias("l"), F.count("*").alias("members")).where("members > 1").select("h", "band", F.col("l.node").alias("a"), F.col("l.n").alias("m"))
    stars = tiles.join(leader, ["h", "band"]).where((F.col("node") != F.col("a")) & _fits("n", "m")).groupBy("a", F.col("node").alias("b")).agg(F.count_distinct("h").alias("times")).where(F.col("times") >= SHARED)
    first = verified(saved(bounded(saved(stars))))

    may = (F.col("a.h") == F.col("b.h")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.c") != F.col("b.c")) & (F.col("a.own") | F.col("b.own")) & _fits("a.n", "b.n") & bound

    def open_tiles(found: DataFrame) -> DataFrame:
        """The tiles whose members are in different components, with components and bitmaps."""
        named = tiles.join(small(found), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        split = named.groupBy("h", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h", "band")
        return saved(saved(named.join(split, ["h", "band"])).join(small(bits.drop("n"), 20_000), "node"))

    def proposed(pairs: DataFrame) -> DataFrame:
        one, other = F.least("a.node", "b.node"), F.greatest("a.node", "b.node")
        return saved(pairs.groupBy(one.alias("a"), other.alias("b")).agg(F.count_distinct("a.h").alias("times")).where(F.col("times") >= SHARED))

    # while many pairs are open, further leaders (other members by hash) draw in those that the first ones missed
    links, left = first, open_tiles(components(first))
    for turn in range(ROUNDS):
        per = left.groupBy("h", "band", "c").agg(F.count("*").alias("m")).groupBy("h", "band").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("open"), F.sum("m").alias("m"))
        total = per.agg(F.sum("open").alias("open"), F.sum("m").alias("m")).first()
        if (total["open"] or 0) <= OPEN * (total["m"] or 0):
            break
        order = [F.xxhash64("node", F.lit(turn * LEADERS + k)) for k in range(LEADERS)]
        least = left.groupBy("h", "band").agg(*(F.min(x).alias(f"l{k}") for k, x in enumerate(order)))
        chosen = left.join(least, ["h", "band"]).where(reduce(or_, (x == F.col(f"l{k}") for k, x in enumerate(order)))).select(*left.columns)
        links = saved(links.unionByName(verified(proposed(left.alias("a").join(chosen.alias("b"), may)))))
        left = open_tiles(components(links))
    # the rest: the pairs of open tiles that the sizes and the bitmaps allow; where a tile is large its members meet by their rarest shingles instead
    large = saved(left.groupBy("h", "band").agg(F.count("*").alias("m")).where(F.col("m") > TILE).select("h", "band"))
    if large.isEmpty():
        pairs = proposed(left.alias("a").join(left.alias("b"), may & (F.col("a.node") < F.col("b.node"))))
    else:
        few = saved(left.join(small(large), ["h", "band"], "left_anti"))
        many = saved(left.join(small(large), ["h", "band"], "left_semi").drop("h", "band", "own").dropDuplicates(["node"]))
        met = saved(_rarest(saved(arrays.join(small(many), "node"))))
        most = F.least("a.common", "b.common")  # no pair shares more
        rare = met.alias("a").join(met.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.c") != F.col("b.c")) & _fits("a.n", "b.n") & ((100 + THRESHOLD) * most >= THRESHOLD * (F.col("a.n") + F.col("b.n"))) & bound)
        pairs = proposed(few.alias("a").join(few.alias("b"), may & (F.col("a.node") < F.col("b.node")))).select("a", "b")
        pairs = saved(pairs.union(rare.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))).distinct())
    return rows.select("k_id", "k_row", "doc_id", "node", "n"), components(links.unionByName(verified(pairs)))


def link_components(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: k_id, k_row, doc_id, n_shingles, component_id (smallest doc_id reachable by links), rep (key of the row that stands for the component)."""
    rows, found = similar_classes(docs)
    named = saved(rows.join(small(found), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    least = saved(named.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"), F.min(F.struct("k_id", "k_row")).alias("rep")))
    return named.join(least, "c", "left").select("k_id", "k_row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "rep")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row left of each component (smallest id, then row hash), and one of rows equal in id, text and source (the least by a hash of all its columns); texts without shingles all stay."""
    named = saved(link_components(docs))
    kept = without(docs, saved(named.where("rep is not null and (k_id <> rep.k_id or k_row <> rep.k_row)").select("k_id", "k_row").distinct()))
    again = saved(named.where("rep is not null").groupBy("k_id", "k_row").agg(F.count("*").alias("n")).where("n > 1").select("k_id", "k_row"))
    if again.isEmpty():
        return kept
    keyed = kept.select(whole(kept).alias("doc"), *row_key())
    twice = keyed.join(small(again), ["k_id", "k_row"], "left_semi")
    once = twice.groupBy("k_id", "k_row").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    return without(kept, again).unionByName(once.select(*(F.col("doc")[c].alias(c) for c in kept.columns)))
