"""Target-distribution importance resampling over hashed runs of one to three words, by partition-local word tries.

The words of a stretch of a partition's texts make a trie of depth three: a node is a run of words and
holds how often it stands there and the state of a CRC-32 over its letters, which is that of its parent carried on over a blank and
the word. The nodes' counts are added up by bucket, the partitions' totals are merged, and every bucket gets a gain: the log ratio
of its share in the target to its share in the corpus. A second pass builds the tries again, hangs
on each node the gains of its whole path, and scores each document as the sum over the paths that its words walk. The
draw takes the highest scores with Gumbel noise from a hash of the id, which is sampling without replacement.

Tries hold at most BLOCK words and are then emptied into the totals, so a worker's memory has a bound and no feature is left out.

Defined cases: a null or empty text has no features, weight 0 and is never drawn; a null id hashes as the empty string and
ranks before others of its score; repeated rows are scored and drawn each (which of them comes first is open, they are alike);
of equal scores the smaller doc_id comes first; a very long text is worked in stretches of BLOCK words; an empty table gives
no rows, an empty target leaves every bucket with the gain of the pseudo-counts; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import _text as tx
from ledgerflow.llm._spark import in_arrow, saved
from ledgerflow.llm._words import blocks, coded, gathered
from ledgerflow.operators.ranking import ranked

#: Production parameters: buckets, documents drawn in a hundred, least words of a document that can be drawn, salt of the noise.
BUCKETS, PERCENT, LEAST_WORDS, SALT = 10_000, 5, 20, "42"
#: Words of a trie, and bytes of text that are read for one.
BLOCK, GATHER = 1 << 20, 6 << 20

#: Bytes of words: digits, letters, and all of characters beyond ASCII.
INSIDE = tx.byte_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


@cache
def _ahead() -> list[np.ndarray]:
    """For each k, tables that carry a CRC over 2**k zero bytes, one for each byte of the CRC: the map is linear."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    tables = [np.stack([_carry(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), lambda x: (x >> np.uint32(8)) ^ one[x & np.uint32(255)]) for k in range(4)])]
    while len(tables) < 32:
        t = tables[-1]
        tables.append(np.stack([_carry(t[k], lambda x, t=t: _step(t, x)) for k in range(4)]))
    return tables


def _carry(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return f(x).astype(np.uint32)


def _step(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & np.uint32(255)] ^ t[1][(x >> np.uint32(8)) & np.uint32(255)] ^ t[2][(x >> np.uint32(16)) & np.uint32(255)] ^ t[3][x >> np.uint32(24)]


def carried(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after so many more bytes, before these are added in."""
    out = crc.copy()
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        at = np.flatnonzero((size >> k) & 1)
        out[at] = _step(_ahead()[k], out[at])
    return out


class Trie:
    """A trie of the runs of one to three words that begin in a stretch of words.

    words: a number for each word, and for up to two behind the stretch; row: their texts; n: the words of the stretch;
    names: bytes of the words by number. Levels are arrays of nodes: count, crc, parent; at: the node of each place (-1: its text ends before).
    """

    def __init__(self, words: np.ndarray, row: np.ndarray, n: int, names: pa.LargeBinaryArray):
        letters = names.to_pylist()
        size = np.array([len(x) + 1 for x in letters], np.int64)
        own = np.array([zlib.crc32(x) for x in letters], np.uint32)
        spaced = np.array([zlib.crc32(b" " + x) for x in letters], np.uint32)
        at = words[:n]
        self.at, self.crc, self.parent, self.count = [at], [own], [np.zeros(len(letters), np.int64)], [np.bincount(at, minlength=len(letters))]
        for depth in (1, 2):
            live = np.flatnonzero(row[:n][: max(len(words) - depth, 0)] == row[depth : n + depth])
            key, node = np.unique(at[live] * len(letters) + words[live + depth], return_inverse=True)
            parent, word = np.divmod(key, max(len(letters), 1))
            self.parent.append(parent)
            self.crc.append(carried(self.crc[-1][parent], size[word]) ^ spaced[word])
            self.count.append(np.bincount(node, minlength=len(key)))
            at = np.full(n, -1)
            at[live] = node
            self.at.append(at)

    def add_to(self, totals: np.ndarray) -> None:
        for crc, count in zip(self.crc, self.count, strict=True):
            totals += np.bincount(crc % len(totals), count, len(totals)).astype(np.int64)

    def walked(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains on the path of each place, gains being by bucket."""
        path = gains[self.crc[0] % len(gains)]
        total = path[self.at[0]]
        for crc, parent, at in zip(self.crc[1:], self.parent[1:], self.at[1:], strict=True):
            path = path[parent] + gains[crc % len(gains)]
            deep = at >= 0
            total[deep] = path[at[deep]]
        return total


def _tries(column: pa.Array) -> Iterator[tuple[tx.Chunk, np.ndarray, Iterator[tuple[int, int, Trie]]]]:
    """(chunk, text of each word, tries of its stretches with their first and last word)."""
    for c in tx.chunks(column, GATHER):
        row, start, end = c.words(INSIDE[c.data])

        def each(data=None, row=row, start=start, end=end, c=c) -> Iterator[tuple[int, int, Trie]]:
            data = tx.LOWER[c.data]
            for lo, hi, last in blocks(len(row), BLOCK, 2):
                words, names = coded(data, start[lo:last], end[lo:last])
                yield lo, hi, Trie(words, row[lo:last], hi - lo, names)

        yield c, row, each()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, np.int64)
    for batch in gathered(batches, "text", GATHER):
        for _, _, tries in _tries(batch.column("text")):
            for _, _, trie in tries:
                trie.add_to(totals)
    at = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts by bucket, at most BUCKETS rows."""
    return in_arrow(texts.select("text"), _counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, each count one higher."""
    s, t = float(corpus.sum()) + len(corpus), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(gain: np.ndarray) -> Callable:
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", GATHER):
            for c, row, tries in _tries(batch.column("text")):
                total = np.zeros(c.n, np.int64)
                for lo, hi, trie in tries:
                    np.add.at(total, row[lo:hi], trie.walked(gain))
                n = np.bincount(row, minlength=c.n)
                features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, c.n), *(pa.array(x, pa.int64()) for x in (n, features, total))], names=["doc_id", "n_words", "n_features", "weight"])

    return weights


def _whole(counts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def weighted(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight: each row of docs against the texts of target."""
    gain = gains(_whole(bucket_counts(docs)), _whole(bucket_counts(target)))
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _weights(gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, salt: str = SALT) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; rank is null where a row is not drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = saved(weighted(docs, target).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("place_", F.monotonically_increasing_id()))
    can = scored.where(F.col("n_words") >= least)
    drawn = percent * can.count() // 100
    placed = ranked(can, [F.desc("score"), F.col("doc_id"), F.col("place_")])  # the place tells repeated rows apart, so they too are dealt to ranges
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(rest.select(*columns, "rank"))


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn documents alone, by rank: doc_id, rank."""
    return resampled(docs, target, **parameters).where("rank is not null").select("doc_id", "rank")
