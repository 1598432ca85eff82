"""Best-two-fit packing of tokenised documents into sequences of at most SIZE tokens.

pieces() tokenises whole texts and cuts only documents longer than a sequence: full sequences from their
end, so that the first piece alone may be shorter. packed() deals the pieces by hash into groups of about
GROUP pieces (a bound on the work of a task, whatever the input) and fills each group's bins: greedily with the
longest piece that fits, then, if a gap is left, the bin's smallest piece is put back for the two
unpacked pieces that fill the widened gap best, where those fill more.

Defined cases: a null or empty text is the closing token alone; repeated rows are packed each, spread over the groups;
a null id is kept; pieces of one length are taken in the order of doc_id, piece and checksum; a very long text is cut whole
into as many pieces as it needs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm._spark import in_arrow, saved
from ledgerflow.llm._tokens import library

SIZE, CLOSE, GROUP = 2048, 0, 8_000


def _cut(path: str, size: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = library(path)
        for batch in batches:
            for c, flat, off in v.rows(batch.column("text")):
                rows = []
                for k in range(c.n):
                    ids = np.append(flat[off[k] : off[k + 1]], np.uint32(CLOSE)).astype("<u4")
                    first = (len(ids) - 1) % size + 1
                    cuts = [0, *range(first, len(ids) + 1, size)]
                    rows += [(k, p, s, e - s, zlib.crc32(ids[s:e])) for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                k, *rest = zip(*rows, strict=True)
                ids = batch.column("doc_id").take(pa.array(np.array(k) + c.first))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; tokenizer: path of a byte-level BPE file."""
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _cut(tokenizer, size), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each piece, its offset there, number of bins)."""
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(size + 2))
    left = np.diff(first)  # unpacked pieces of each length 0..size
    bins, left_all = [], int(left.sum())
    while left_all:
        have = np.flatnonzero(left)
        full, room = [], size
        while room and (k := int(np.searchsorted(have, room, "right"))):
            x = int(have[k - 1])
            times = min(room // x, int(left[x]))
            full += [x] * times
            room -= x * times
            left[x] -= times
            if not left[x]:
                have = np.delete(have, k - 1)
        if room and len(full) > 1 and len(have):
            small = full[-1]
            wide = room + small
            at = np.searchsorted(have, wide - have, "right") - 1  # the longest partner of each length
            pair = np.where(at >= 0, have + have[at], -1)
            alone = (at >= 0) & (have[at] == have) & (left[have] < 2)
            next_ = np.where(at > 0, have + have[np.maximum(at - 1, 0)], -1)
            pair = np.where(alone, next_, pair)
            if pair.max() > small:
                k = int(pair.argmax())
                x, y = int(have[k]), int(pair[k] - have[k])
                full[-1:] = [x, y]
                left[x] -= 1
                left[y] -= 1
                left[small] += 1
        bins.append(full)
        left_all -= len(full)
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    taken = first[:-1].copy()
    for b, full in enumerate(bins):
        at = 0
        for x in full:
            i = order[taken[x]]
            taken[x] += 1
            bin_of[i], offset[i] = b, at
            at += x
    return bin_of, offset, len(bins)


def packed(cut: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """cut (the rows of pieces()) with sequence_id and offset; sequences have no gaps."""
    cut = saved(cut)
    groups = max(1, -(-cut.count() // group))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)  # the same whatever order rows arrive in
        bin_of, offset, _ = best_two_fit(pdf["length"].to_numpy(), size)
        return pdf.assign(sequence_id=pdf["k_group"].to_numpy(np.int64) * (1 << 32) + bin_of, offset=offset).drop(columns="k_group")

    # the place in the written table deals equal pieces out too, and a task that runs again deals them alike
    dealt = cut.withColumn("k_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("k_group").applyInPandas(fill, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
