"""Byte-level BPE ids of many texts at once: vectorised splitting, and a cache from word to ids.

The split is that of the byte-level tokenizers of the GPT-2 family: contractions, then runs of letters, digits or other
signs with one blank before them, then white space. It is found with class tables on code points; words
are looked up by hash, and only new words go to the tokenizers library. Texts that hold a special
token's string, or code points outside the scripts tabled here, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from ledgerflow.llm import _text as tx
from ledgerflow.llm._spark import CACHES

LETTER, NUMBER, OTHER, BLANK, RARE = 1, 2, 3, 4, 5
#: Code point ranges whose classes all Unicode versions of the last ten years agree on.
KNOWN = ((0x0000, 0x0378), (0x0400, 0x0528), (0x1E00, 0x1F00), (0x2000, 0x2065), (0x20A0, 0x20B8), (0x2190, 0x2300), (0x3000, 0x3030), (0x3041, 0x3097), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
#: The endings that stay with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
MOST_WORDS = 1_000_000
SLOTS = 21


@cache
def classes() -> np.ndarray:
    t = np.full(0x110000, RARE, np.uint8)
    for lo, hi in KNOWN:
        for x in range(lo, hi):
            kind = unicodedata.category(ch := chr(x))
            t[x] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else BLANK if ch.isspace() and not 0x1C <= x <= 0x1F else RARE if kind == "Cn" else OTHER
    return t


def split(c: tx.Chunk, spaced: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte positions of the words' starts, of their ends, rows with rare code points).

    spaced: a word takes the blank before it and white space is words too; else white space is left out
    and each digit is a word.
    """
    lead = np.flatnonzero((c.data & 0xC0) != 0x80)
    code = np.frombuffer(c.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    n = len(code)
    row0 = np.zeros(n + 1, bool)  # a text starts here
    row0[np.searchsorted(lead, c.off)] = True
    turn = row0.copy()
    turn[1:n] |= kind[1:] != kind[:-1]
    turn[n] = True
    start = turn[:n].copy()
    if spaced:
        # the last blank of a run before a word goes with the word if it is a space, else stands alone
        last = np.flatnonzero((kind == BLANK) & turn[1:] & ~row0[1:])
        start[last] = True
        start[last[code[last] == 32] + 1] = False
    else:
        start |= kind == NUMBER
    # contractions: an apostrophe alone that starts a word, and a known ending
    mark = np.flatnonzero((code == 39) & turn[:n] & turn[1:] & start)
    mark = mark[mark + 1 < n]
    mark = mark[~row0[mark + 1]]
    if len(mark):
        open_ = np.ones(len(mark), bool)
        for e in ENDINGS:
            fit = open_ & (mark + len(e) < n)
            for k, ch in enumerate(e, 1):
                at = np.minimum(mark + k, n - 1)
                fit &= (code[at] == ord(ch)) & ~row0[at]
            start[mark[fit] + 1] = False
            after = mark[fit] + 1 + len(e)
            start[after[after < n]] = True
            open_ &= ~fit
    rare = np.unique(c.doc_of(lead[kind == RARE])) if (kind == RARE).any() else np.zeros(0, np.int64)
    first = lead[start]
    end = np.append(first[1:], len(c.data))
    if not spaced:
        word = kind[start] != BLANK
        first, end = first[word], end[word]
    return first, end, rare


class WordIds:
    """Ids of words; words seen before are found by hash. encode: ids of each of some words."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # of each key: its number
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.slot_key, self.slot_at = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)

    def _search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.at[k], self.keys[k] == h

    def learn(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Encode the new words of (data, start, end, hash) of some chunks."""
        if len(self.count) > self.most:
            self.clear()
        keys, words = [], []
        for data, start, end, h in found:
            miss = np.flatnonzero(self.slot_key[(h >> np.uint64(64 - SLOTS)).astype(np.int64)] != h)
            miss = miss[~self._search(h[miss])[1]]
            new, where = np.unique(h[miss], return_index=True)
            where = miss[where]
            text = data.tobytes()
            keys.append(new)
            words += [text[s:e] for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)]
        new, where = np.unique(np.concatenate(keys), return_index=True)
        if not len(new):
            return
        ids = self.encode([words[k].decode("utf-8") for k in where.tolist()])
        count = np.array([len(x) for x in ids])
        base, total = len(self.flat), len(self.count)
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, count.sum())))
        self.first = np.concatenate((self.first, base + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        keys, at = np.concatenate((self.keys, new)), np.concatenate((self.at, total + np.arange(len(new))))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of learned words one after the other, where each word's begin and the last end)."""
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        which = self.slot_at[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_key[slot] != h)
        if len(miss):
            which[miss], _ = self._search(h[miss])
            self.slot_key[slot[miss]], self.slot_at[slot[miss]] = h[miss], which[miss]
        count = self.count[which]
        ends = np.cumsum(count)
        flat = self.flat[np.repeat(self.first[which] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate(([0], ends))


def token_rows(column: pa.Array, words: WordIds, spaced: bool, special: list[bytes], whole: Callable[[str], np.ndarray], limit: int) -> Iterator[tuple[tx.Chunk, np.ndarray, np.ndarray]]:
    """(chunk, ids of its rows, where each row's begin and the last end); new words are learned for about limit bytes at a time."""
    held: list[tuple] = []

    def flush() -> Iterator[tuple[tx.Chunk, np.ndarray, np.ndarray]]:
        words.learn([(c.data, s, e, h) for c, s, e, h, _ in held])
        for c, start, _, h, rare in held:
            flat, at = words.ids(h)
            off = at[np.searchsorted(start, c.off)]
            text, odd = c.data.tobytes(), set(rare.tolist())
            for mark in special:
                k = text.find(mark)
                while k >= 0:
                    odd.add(int(c.doc_of(np.array([k]))[0]))
                    k = text.find(mark, k + 1)
            if odd:
                rows = [flat[off[k] : off[k + 1]] for k in range(c.n)]
                for k in odd:
                    rows[k] = whole(text[c.off[k] : c.off[k + 1]].decode("utf-8"))
                flat, off = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
            yield c, flat, off
        held.clear()

    for c in tx.chunks(column):
        if len(c.data):
            start, end, rare = split(c, spaced)
            held.append((c, start, end, tx.range_hashes(c.data, start, end), rare))
        else:
            held.append((c, *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        if sum(len(x[0].data) for x in held) >= limit:
            yield from flush()
    if held:
        yield from flush()


class Library:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordIds(self.encode)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def rows(self, column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[tx.Chunk, np.ndarray, np.ndarray]]:
        return token_rows(column, self.words, True, self.special, lambda t: np.array(self.encode([t])[0], np.uint32), limit)


@cache
def library(path: str) -> Library:
    return Library(path)


CACHES.append(library.cache_clear)
