"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a batch are laid end to end as one sequence of symbols. An index maps the rank of
each mergeable pair to all its positions; the active ranks are applied in ascending order from a
heap, each to all its positions at once, and the pairs that a merge makes are added to the lists of their ranks. Ids
and decoded strings of words are kept in the worker, so a word is merged once.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the strings of special
tokens are one token each, as in the library; of equal pairs the lower rank goes first, and in a run of one symbol the pairs
from the left; repeated rows are coded each; a very long text is coded whole (some tens of bytes of memory a byte);
an empty table gives no rows; other columns are not read; rows are never merged or lost.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm._spark import in_arrow
from ledgerflow.llm._tokens import KNOWN, WordIds, token_rows

#: Bytes of text whose new words are merged together.
TOGETHER = 32 << 20
#: Code points whose lower case or composition Unicode versions may not agree on.
UNSURE = re.compile("[^" + "".join(f"{re.escape(chr(lo))}-{re.escape(chr(hi - 1))}" for lo, hi in KNOWN) + "]")


def _byte_chars() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE of whole words with a word-end suffix, read from a tokenizers file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in chain(vocab.items(), self.special.items()):
            self.names[i] = name
        chars, suffix = _byte_chars(), model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[ch] for ch in chars])
        self.final = np.array([vocab[ch + suffix] for ch in chars])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges])
        self.right = np.array([vocab[b] for _, b in merges])
        self.made = np.array([vocab[a + b] for a, b in merges])
        key = self.left << 32 | self.right
        self.rank = np.argsort(key, kind="stable")
        self.pair = key[self.rank]
        self.words = WordIds(self.merge)
        raw = [x.encode("utf-8") + b" " for x in self.names]
        self.name_size = np.array([len(x) for x in raw])
        self.name_first = np.cumsum(self.name_size) - self.name_size
        self.name_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[k] == key) & (right >= 0) & (left >= 0), self.rank[k], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(r) for r in raw])
        ends = np.cumsum(size + 1)  # one stop after each word
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        sym = self.inner[data]
        sym[ends - 2] = self.final[data[ends - 2]]
        sym[ends - 1] = -1
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = self.ranks(sym[:-1], sym[1:])
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        which, cut = np.unique(rank[at], return_index=True)
        index: dict[int, list] = {int(r): [p] for r, p in zip(which, np.split(at, cut[1:]), strict=True)} if len(at) else {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            p = np.unique(np.concatenate(index.pop(r)))
            a, b = self.left[r], self.right[r]
            p = p[sym[p] == a]
            q = after[p]
            ok = sym[q] == b
            p, q = p[ok], q[ok]
            if a == b and len(p) > 1 and (q[:-1] == p[1:]).any():  # runs of one symbol: pairs from the left, without overlap
                keep, last = [], -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    if x != last:
                        keep.append(i)
                        last = y
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            sym[p], sym[q] = self.made[r], -2
            after[p] = after[q]
            before[after[p]] = p
            prior, follow = before[p], after[p]
            inside = prior >= 0
            left = np.concatenate((prior[inside], p))
            new = self.ranks(sym[left], np.concatenate((sym[p[inside]], sym[follow])))
            hit = np.flatnonzero(new >= 0)
            if len(hit):
                hit = hit[np.argsort(new[hit], kind="stable")]
                which, cut = np.unique(new[hit], return_index=True)
                for x, y in zip(which.tolist(), np.split(left[hit], cut[1:]), strict=True):
                    if x in index:
                        index[x].append(y)
                    else:
                        index[x] = [y]
                        heapq.heappush(heap, x)
        live = np.flatnonzero(sym >= 0)
        return np.split(sym[live], np.searchsorted(live, ends[:-1]))

    def folded(self, text: str) -> str:
        """The text as the tokenizer's file has it normalised: by the library itself where it holds code points that are not tabled."""
        if text.isascii():
            return text.lower()
        if UNSURE.search(text):
            return parts(self.path).normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a capital sigma has one lower case here, at word ends too

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, by the pattern itself and with the strings of special tokens as tokens."""
        parts = [np.array([self.special[x]]) if k % 2 else self.plain(self.folded(x)) for k, x in enumerate(self.at_special(text))]
        return np.concatenate(parts).astype(np.uint32)

    def plain(self, folded: str) -> np.ndarray:
        if UNSURE.search(folded):  # classes too may differ between Unicode versions
            words = [folded[a:b] for _, (a, b) in parts(self.path).pre_tokenizer.pre_tokenize_str(folded)]
        else:
            words = self.find(folded)
        return np.concatenate(self.merge(words)).astype(np.uint32) if words else np.zeros(0, np.uint32)

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text. Texts with special strings are folded only in between, so they go the slow way."""
        texts = [t or "" for t in column.to_pylist()]
        slow = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = pa.array(["" if k in slow else self.folded(t) for k, t in enumerate(texts)], pa.large_string())
        for c, flat, off in token_rows(plain, self.words, False, [], self.plain, TOGETHER):
            for k in range(c.n):
                row = c.first + k
                yield row, self.whole(texts[row]) if row in slow else flat[off[k] : off[k + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8: the tokens' names with one space between."""
        size = self.name_size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.name_bytes[np.repeat(self.name_first[ids] - (ends - size), size) + np.arange(ends[-1])][:-1].tobytes()


@cache
def parts(path: str):
    """The library's tokenizer, for its normaliser and splitter alone."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _digests(path: str) -> Callable:
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            n, a, b = [], [], []
            for _, ids in bpe.rows(batch.column("text")):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _ids(path: str) -> Callable:
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            rows = [x.astype(np.int32) for _, x in bpe.rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array([bpe.decode(x).decode("utf-8") for x in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return ids


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; tokenizer: path of a word BPE file."""
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _digests(tokenizer), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string for each row of docs."""
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _ids(tokenizer), "doc_id bigint, ids array<int>, decoded string")
