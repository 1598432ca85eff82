"""Quality rules: measures of each text, and the frequency of its lines across the documents of its host.

measure() is one pass over the texts. frequent_lines() counts, for each host and normalised line, the
distinct documents (equal texts count once, so copies do not condemn each other) and keeps the lines
above a limit. verdicts() takes those lines out and rejects documents of which too little is left;
without_frequent_lines() gives the texts less those lines.

Defined cases: a null text is an empty one (no words, base_failed); a null source counts as the empty host;
lines without a word are never counted; a line at a limit is not frequent and a document with just the least share left
is not depleted; repeated rows are judged each for itself; a very long text is hashed in pieces and judged whole (a
few tens of bytes a word); an empty table gives no rows; other columns of the input are not read, and the
filters hand them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm import _text as tx
from ledgerflow.llm._spark import BATCH_BYTES, in_arrow, members, row_key, saved, small, whole, without
from ledgerflow.llm.linefreq import with_text

#: Production parameters. A line is frequent when it stands in more than MAX_SHARE of a host's distinct documents, and in more than MAX_DOCS of them: a small floor, below which a share says nothing.
MAX_DOCS, MAX_SHARE = 5, 0.05
#: A document is depleted when frequent lines leave less than this share of its word characters.
MIN_LEFT = 0.3

SYMBOLS = tx.byte_table(b"#*$%&|<>")
#: Lines are compared in lower case, with digits alike, and with one space between words.
NORMAL = tx.LOWER.copy()
NORMAL[48:58] = 48

MEASURED = "k_id bigint, k_row bigint, k_text bigint, doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, weights array<bigint>"


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.sort(hashes)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(hashes), bool)
    return twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes


def _chunk(c: tx.Chunk) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
    inside = ~tx.SPACE[c.data]
    row, start, end = c.words(inside)
    letter = inside & ((c.data & 0xC0) != 0x80)
    n_words = np.bincount(row, minlength=c.n)

    win, at = tx.windows(tx.range_hashes(c.data, start, end), row, 5)
    twice = at[_repeated(tx.mix(win ^ tx.mix(row[at].astype(np.uint64))))]
    cover = np.bincount(twice, minlength=len(row) + 5) - np.bincount(twice + 5, minlength=len(row) + 5)
    n_repeat = np.bincount(row[np.cumsum(cover)[: len(row)] > 0], minlength=c.n)

    lrow, ls, le = c.lines()
    first, last = np.searchsorted(start, ls), np.searchsorted(start, le)
    full = last > first
    lrow, ls, le, first, last = (x[full] for x in (lrow, ls, le, first, last))
    exact = tx.range_hashes(c.data, ls, le)
    order = np.lexsort((exact, lrow))
    same = (exact[order][1:] == exact[order][:-1]) & (lrow[order][1:] == lrow[order][:-1])
    n_dup = np.bincount(lrow[order][1:][same], minlength=c.n)

    key = tx.sequence_hash(tx.range_hashes(NORMAL[c.data], start, end), first, last)
    chars = np.concatenate(([0], np.cumsum(letter)))
    weight = chars[le] - chars[ls]
    order = np.lexsort((key, lrow))  # one entry for each distinct line of a document, with all its characters
    key, lr, weight = key[order], lrow[order], weight[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lr[1:] != lr[:-1])))) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, new) if len(new) else weight
    return (
        [n_words, c.per_row(letter), c.per_row(SYMBOLS[c.data]), n_dup, n_repeat],
        tx.lists(lr[new], c.n, tx.signed(key[new]), pa.int64()),
        tx.lists(lr[new], c.n, weight, pa.int64()),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in tx.chunks(batch.column("text")):
            part = batch.slice(c.first, c.n)
            numbers, lines, weights = _chunk(c)
            yield pa.RecordBatch.from_arrays(
                [part.column(x) for x in ("k_id", "k_row", "k_text", "doc_id", "host")] + [pa.array(x, pa.int64()) for x in numbers] + [lines, weights],
                names=["k_id", "k_row", "k_text", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "weights"],
            )


def measure(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): the measures, and its distinct normalised lines with their word characters."""
    k_id, k_row = row_key()
    rows = docs.select(k_id, k_row, F.xxhash64("text").alias("k_text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text")
    return in_arrow(rows, _measure, MEASURED)


def frequent_lines(measured: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, frequent array<bigint>): a host has fewer than its mean lines per document / max_share of them."""
    texts = measured.select("host", "k_text", "lines").dropDuplicates(["host", "k_text"])
    total = texts.groupBy("host").agg(F.count("*").alias("docs"))
    lines = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    return lines.join(small(saved(total)), "host").where(F.col("n") > max_share * F.col("docs")).groupBy("host").agg(F.collect_list("line").alias("frequent"))


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """measure() without its arrays, with base_failed, left_chars (outside frequent lines) and kept."""
    measured = saved(measure(docs))
    frequent = small(saved(frequent_lines(measured, max_docs, max_share)), 10_000)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    judged = measured.join(frequent, "host", "left").withColumn("gone", members(F.col("lines"), F.col("frequent")))
    gone = F.expr("case when gone is null then 0L else aggregate(zip_with(gone, weights, (g, w) -> case when g then w else 0L end), 0L, (a, b) -> a + b) end")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        judged.withColumn("left_chars", F.col("word_chars") - gone)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("left_chars") >= min_left * F.col("word_chars")))
        .select("k_id", "k_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_chars", "base_failed", "kept")
    )


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that verdicts() keeps, with all their columns."""
    return without(docs, saved(verdicts(docs, **limits).where("not kept").select("k_id", "k_row").distinct()))


def _line_keys(c: tx.Chunk, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash of the normalised words, as in _chunk) of the lines with a word; start and end are the words' places."""
    row, ls, le = c.lines()
    first, last = np.searchsorted(start, ls), np.searchsorted(start, le)
    full = last > first
    row, ls, le, first, last = (x[full] for x in (row, ls, le, first, last))
    return row, ls, le, tx.sequence_hash(tx.range_hashes(NORMAL[c.data], start, end), first, last)


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, frequent, out = batch.column("text"), batch.column("frequent"), []
        for c in tx.chunks(column):
            _, start, end = c.words(~tx.SPACE[c.data])
            row, ls, le, key = _line_keys(c, start, end)
            span = np.searchsorted(row, np.arange(c.n + 1))
            for k in range(c.n):
                text, drop, mine = column[c.first + k].as_py(), frequent[c.first + k], slice(span[k], span[k + 1])
                gone = np.isin(tx.signed(key[mine]), drop.values.to_numpy()) if drop.is_valid else np.zeros(0, bool)
                if gone.any():
                    starts = set((ls[mine][gone] - c.off[k]).tolist())
                    at, left = 0, []
                    for line in text.encode().split(b"\n"):
                        if at not in starts:
                            left.append(line)
                        at += len(line) + 1
                    text = b"\n".join(left).decode()
                out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], names=["doc", "text"])


def without_frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Every row of docs, its text less the frequent lines of its host (a null text stays null), with all its columns; n_chars follows the text."""
    frequent = small(saved(frequent_lines(saved(measure(docs)), max_docs, max_share)), 10_000)
    rows = docs.select(whole(docs).alias("doc"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("own_host"))
    rows = rows.join(frequent, F.col("own_host") == F.col("host"), "left").select("doc", "text", "frequent")
    return with_text(in_arrow(rows, _stripped, T.StructType([rows.schema["doc"], T.StructField("text", T.StringType())])), docs.columns)
