"""Collocations: runs of two and three words that stand together far more often than their parts.

A shard is a stretch of a partition's words, as numbers. Its suffix array is built in numpy by prefix doubling: places are ranked by
one word, then by the pairs of ranks one, two ... words apart, which orders them by two, four ... words, no run going beyond its piece
of text. Longest common prefixes of neighbours cut the array into intervals; each interval of depth k is a run of k words, and
its length is the run's count in the shard. Counts are merged over all shards by (lang, run).

Runs of three words go over the network only if both their pairs may be frequent: a Bloom filter of fixed size holds the pairs that are,
and what it lets through by mistake is counted all the same and dropped by its count. Nothing else is left out: a run that is
frequent has frequent parts.

Defined cases: a null or empty text has no words; a null lang is `und`; words keep all characters but A-Z as they are; a run at the
least count is a candidate; scores are exact whole numbers (decimals of 38 digits: counts below 10**15); of cuts with one score the
first counts; phrases of one score and count go by their UTF-8 bytes; repeated rows count each; a very long text is worked in
stretches; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import _text as tx
from ledgerflow.llm._spark import in_arrow, saved
from ledgerflow.llm._words import blocks, coded, gathered
from ledgerflow.operators.ranking import ranked

#: Production parameters: least count of a candidate, words of the longest, share in a hundred at which a longer candidate takes its parts' place, phrases of a language.
LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
#: Words of a shard, and bytes of text that are read for one.
SHARD, GATHER = 1 << 19, 3 << 20
#: Bits of the filter of frequent pairs (fixed: 4 MB), and of its hashes.
BITS, HASHES = 1 << 25, 4

SPLIT = tx.byte_table(b".,;:!?\n\v\f\r")
BLANK = pa.scalar(" ", pa.large_string())
INSIDE = ~(SPLIT | tx.byte_table(b" \t"))


def suffix_array(rank: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by their first depth words or more, by prefix doubling; a run ends with its piece, and goes before its continuations."""
    n, known = len(rank), 1
    order = np.argsort(rank) if depth == 1 else None
    while known < depth:
        after = np.zeros(n, np.int64)
        if n > known:
            after[:-known] = np.where(piece[:-known] == piece[known:], rank[known:] + 1, 0)
        key = rank * (after.max(initial=0) + 1) + after
        order = np.argsort(key)
        known *= 2
        if known < depth:
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if n else key
    return order


def prefixes(words: np.ndarray, piece: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(words that each place of the order shares with the one before it, words left in its piece), both up to depth."""
    n = len(words)
    shared, room = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alike = np.ones(n, bool)
    for k in range(depth):
        at = order + k
        inside = at < n
        inside[inside] = piece[at[inside]] == piece[order[inside]]
        room += inside
        word = np.where(inside, words[np.minimum(at, n - 1)], -1)
        alike &= inside
        alike[1:] &= word[1:] == word[:-1]
        alike[:1] = False
        shared += alike
    return shared, room


def intervals(shared: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place in the order, length) of the intervals of places with one run of depth words."""
    live = np.flatnonzero(room >= depth)
    first = live[shared[live] < depth]
    place = np.searchsorted(live, first)
    return first, np.diff(np.append(place, len(live)))


class PairFilter:
    """A Bloom filter of pairs of words, of fixed size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray) -> np.ndarray:
        """HASHES bit numbers of each 64-bit hash."""
        return np.stack([tx.mix(hashes + np.uint64(k)) % np.uint64(BITS) for k in range(HASHES)])

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def _hashes(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes of some words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return tx.range_hashes(np.frombuffer(data, np.uint8), at[:-1], at[1:])


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words, from theirs."""
    return tx.mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.LargeStringArray, pa.Array, int]]:
    """(words, pieces, names, langs, n) of each shard: a word's number is that of its lang times the names, plus that of its name; n words begin runs, the others are looked at."""
    for batch in gathered(batches, "text", GATHER):
        langs = batch.column("lang").dictionary_encode()
        lang_of = langs.indices.to_numpy().astype(np.int64)
        for c in tx.chunks(batch.column("text"), GATHER):
            row, start, end = c.words(INSIDE[c.data])
            ends = np.cumsum(SPLIT[c.data], dtype=np.int32)
            piece = np.cumsum(np.concatenate(([0], (row[1:] != row[:-1]) | (ends[start[1:]] != ends[end[:-1] - 1])))) if len(row) else row
            data = tx.LOWER[c.data]
            for lo, hi, last in blocks(len(row), SHARD, LONGEST - 1):
                words, names = coded(data, start[lo:last], end[lo:last])
                yield lang_of[c.first + row[lo:last]] * len(names) + words, piece[lo:last], names.cast(pa.large_string()), langs.dictionary, hi - lo


def _runs(depths: tuple[int, ...], keep: PairFilter | None = None) -> Callable:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, piece, names, langs, n in _shards(batches):
            order = suffix_array(words, piece, max(depths))
            order = order[order < n]  # runs that begin in the shard
            shared, room = prefixes(words, piece, order, max(depths))
            own = _hashes(names) if keep is not None else None
            for depth in depths:
                first, count = intervals(shared, room, depth)
                at = order[first]
                if keep is not None:
                    good = np.ones(len(at), bool)
                    for k in range(depth - 1):
                        good[good] = keep.may_hold(_pairs(own[words[at[good] + k] % len(names)], own[words[at[good] + k + 1] % len(names)]))
                    at, count = at[good], count[good]
                for lo in range(0, len(at), 1 << 16):
                    part = at[lo : lo + (1 << 16)]
                    phrase = pc.binary_join_element_wise(*(names.take(pa.array(words[part + k] % len(names))) for k in range(depth)), BLANK).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(words[part] // len(names))).cast(pa.string()), phrase, pa.array(count[lo : lo + (1 << 16)], pa.int64())], names=["lang", "phrase", "f"])

    return runs


def _counted(texts: DataFrame, depths: tuple[int, ...], keep: PairFilter | None = None) -> DataFrame:
    return in_arrow(texts, _runs(depths, keep), "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the filter that the batches' pairs of words set, as (number of a 64-bit word, its bits)."""
    bits = np.zeros(BITS >> 3, np.uint8)
    for batch in batches:
        known = pc.list_flatten(pc.split_pattern(batch.column("phrase"), " ")).dictionary_encode()
        both = _hashes(known.dictionary.cast(pa.large_string()))[known.indices.to_numpy()].reshape(-1, 2)
        for at in PairFilter.places(_pairs(both[:, 0], both[:, 1])):
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    words = bits.view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at], pa.int64())], names=["word", "bits"])


def _filter(pairs: DataFrame) -> PairFilter:
    """The filter of some pairs, merged from those of the partitions: at most BITS / 64 rows come to the driver."""
    words = np.zeros(BITS >> 6, np.int64)
    found = in_arrow(pairs.select("phrase"), _bits, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return PairFilter(words.view(np.uint8))


def run_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all runs of one to three words that stand at least so often; (lang, n): all words)."""
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = F.size(F.split("phrase", " "))
    parts = saved(_counted(texts, (1, 2)).withColumn("size", size).where((F.col("size") == 1) | (F.col("f") >= least)))
    total = parts.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = parts.where(F.col("f") >= least)
    longest = _counted(texts, (LONGEST,), _filter(frequent.where("size = 2"))).where(F.col("f") >= least).withColumn("size", F.lit(LONGEST))
    return saved(frequent.unionByName(longest)), saved(total)


def _words(first: int, n: int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(runs: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, longer) of all candidates; longer: the greatest count of a longer candidate around it, or 0."""
    cand = runs.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda k, left, text: F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), text.alias("part"))
    two = F.array(part(1, True, _words(1, 1)), part(1, False, _words(2, 1)))
    three = F.array(part(1, True, _words(1, 1)), part(1, False, _words(2, 2)), part(2, True, _words(1, 2)), part(2, False, _words(3, 1)))
    asked = cand.select("lang", "phrase", "a", F.inline(F.when(F.col("size") == 2, two).otherwise(three)))
    met = asked.join(runs.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    count = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    per = met.groupBy("lang", "phrase").agg(F.first("a").alias("a"), count(1, True).alias("l1"), count(1, False).alias("r1"), count(2, True).alias("l2"), count(2, False).alias("r2"))
    around = cand.where(F.col("size") == LONGEST).select("lang", F.explode(F.array(_words(1, 2), _words(2, 2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    exact = lambda a, l, r: F.expr(f"cast(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) as decimal(38,0)) div cast(cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)) as decimal(38,0))")  # noqa: E731, E741
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(exact("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    least = per.withColumn("cut", F.array_min(F.filter(F.array(cut(1), cut(2)), lambda x: x.isNotNull())))
    return least.join(around, ["lang", "phrase"], "left").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.coalesce("longer", F.lit(0)).alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then count, then bytes; docs: text, lang."""
    runs, total = run_counts(docs, least)
    own = scored(runs).where((F.col("longer") == 0) | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    placed = ranked(own, [F.desc("score"), F.desc("a"), F.col("phrase")], ["lang"])
    return placed.where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
