"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

What the library does by merging the best pair again and again has one result that can be told by its
neighbours: each piece merges to itself, and the letters of any two adjacent pieces merge to just these two.
So a text is read from the left: an Aho-Corasick automaton over the reversed pieces gives, in one scan from the right, the
longest piece that starts at each place; it is taken if it goes with the piece before it (checked by merging the letters of both anew,
kept for later), else the next shorter one is tried, and where none goes the last piece is taken back. A bitfield
marks the places from which the rest was found impossible, so none is tried twice and time grows with the length.

Places where no piece of the model holds the two characters around them cannot be crossed, so texts are cut before blanks, and what
stands between is encoded once by a worker and then looked up. Characters that are no piece become bytes.

Defined cases: a null or empty text has the end id alone and decodes to the empty text; the marker of blanks in a text counts as
a blank, as in the library; strings of control pieces are plain text; of pairs of one score the left one merges first;
repeated rows are coded each; a very long text is coded whole (some tens of bytes of memory a byte), and so is a single
word of any length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import _text as tx
from ledgerflow.llm._spark import in_arrow
from ledgerflow.llm._tokens import WordIds

#: Fixed value: the character that stands for a blank in pieces.
MARK = "▁"
#: Bytes of text whose new words are encoded together, and pairs of pieces whose check is kept.
TOGETHER, MOST_PAIRS = 8 << 20, 250_000
#: Texts that tell whether a model is of the kind that is built here.
PROBES = ("", " ", "a", " a", "  A b\t\n ", "▁x▁ ▁", "ﬁ Å é 中\U0001f600", "<s> </s> <0x0A> <unk>", "aaaaaaaa", "the  internationalisation")


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    """The strings of some ids one after the other."""
    n = size[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(first[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes() if len(ids) else b""


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in strings])
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size


class PieceCoder:
    """The pieces and scores of a model file. The library reads the file and checks PROBES; it encodes nothing else."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(n)]
        plain = [not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)) for k in range(n)]
        self.end = model.eos_id()
        self.ids = {names[k]: k for k in range(n) if plain[k]}
        self.scores = {p: model.get_score(k) for p, k in self.ids.items()}
        self.bytes = {int(names[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p[::-1], p)
        self.automaton.make_automaton()
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)  # no piece has a blank behind another character
        self.goes: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.words = WordIds(self._words)
        self.decimal = _table([b"%d " % k for k in range(n)])
        self.raw = _table([names[k].replace(MARK, " ").encode() if plain[k] else bytes([int(names[k][3:5], 16)]) if model.is_byte(k) else b"" for k in range(n)])
        if len(self.bytes) != 256 or any(model.is_unused(k) for k in range(n)):
            raise ValueError("pieces for all bytes are needed, and none that are unused")
        for probe in PROBES:
            if list(model.encode(probe)) + [self.end] != self.encode(probe) or model.decode(self.encode(probe)) != self.decode(np.array(self.encode(probe))).decode():
                raise ValueError(f"{path} is not a merge-type model with a blank put before each text and byte fallback")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: of all adjacent pairs that make a piece the one of the highest score, the left one of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: str | None, piece: str) -> bool:
        """Whether a piece may follow another one; a first one must merge to itself."""
        if last is None:
            got = self.alone.get(piece)
            if got is None:
                got = self.alone[piece] = self.merged(piece) == [piece]
            return got
        got = self.goes.get((last, piece))
        if got is None:
            if len(self.goes) >= MOST_PAIRS:
                self.goes.clear()
            got = self.goes[last, piece] = self.merged(last + piece) == [last, piece]
        return got

    def shorter(self, piece: str) -> str | None:
        """The next shorter piece that a piece begins with; a single character always counts as one."""
        for k in range(len(piece) - 1, 0, -1):
            if k == 1 or piece[:k] in self.scores:
                return piece[:k]
        return None

    def cut(self, text: str) -> list[str]:
        """The pieces of a text in which blanks are marked."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for stop, piece in self.automaton.iter(text[::-1]):
            if (before := longest[n - 1 - stop]) is None or len(piece) > len(before):
                longest[n - 1 - stop] = piece
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        at = 0
        piece: str | None = longest[0] or text[0] if n else None
        while at < n:
            last = out[-1] if out else None
            while piece is not None:
                stop = at + len(piece)
                if not failed[stop >> 3] >> (stop & 7) & 1 and self.fits(last, piece):
                    break
                piece = self.shorter(piece)
            if piece is not None:
                out.append(piece)
                at = stop
                piece = (longest[at] or text[at]) if at < n else None
            elif last is None:
                raise AssertionError("no way to cut the text")  # merging always has a result
            else:
                failed[at >> 3] |= 1 << (at & 7)
                out.pop()
                at -= len(last)
                piece = self.shorter(last)
        return out

    def coded(self, marked: str) -> list[int]:
        out: list[int] = []
        for piece in self.cut(marked):
            k = self.ids.get(piece)
            if k is None:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(k)
        return out

    def _words(self, texts: list[str]) -> list[list[int]]:
        return [self.coded(x.replace(" ", MARK)) for x in texts]

    def units(self, text: bytes) -> list[str]:
        """What is encoded by itself: a run of blanks with what follows, or the whole text for models with pieces across."""
        data = np.frombuffer(text, np.uint8)
        start = self._starts(data, np.array([0, len(data)]))
        return [text[a:b].decode() for a, b in zip(start, np.append(start[1:], len(data)), strict=True)]

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        start = np.zeros(len(data) + 1, bool)
        start[off] = True
        if self.cuts:
            blank = data == 32
            start[1:-1] |= blank[1:] & ~blank[:-1]
        return np.flatnonzero(start[:-1])

    def encode(self, text: str) -> list[int]:
        """The ids of one text, with the end id."""
        text = text.replace(MARK, " ")
        return [*chain.from_iterable(self._words(self.units(b" " + text.encode())) if text else []), self.end]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids in UTF-8, without the blank that was put before it."""
        return _gathered(*self.raw, ids).removeprefix(b" ")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, with one blank between."""
        return _gathered(*self.decimal, ids)[:-1]

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: empty), with the end id; new words are encoded for TOGETHER bytes at a time."""
        text = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), MARK, " ")
        text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string())))
        held: list[tuple] = []

        def flush() -> Iterator[np.ndarray]:
            self.words.learn([(c.data, s, e, h) for c, s, e, h in held])
            for c, start, _, h in held:
                flat, at = self.words.ids(h)
                off = at[np.searchsorted(start, c.off)]
                for k in range(c.n):
                    yield np.append(flat[off[k] : off[k + 1]], np.uint32(self.end))
            held.clear()

        for c in tx.chunks(text):
            start = self._starts(c.data, c.off) if len(c.data) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(c.data))[: len(start)]
            held.append((c, start, end, tx.range_hashes(c.data, start, end)))
            if sum(len(x[0].data) for x in held) >= TOGETHER:
                yield from flush()
        if held:
            yield from flush()


@cache
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def _digests(path: str) -> Callable:
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_pieces = coder(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids in with_pieces.rows(batch.column("text")):
                n.append(len(ids))
                a.append(hashlib.sha256(with_pieces.decimals(ids)).hexdigest())
                b.append(hashlib.sha256(with_pieces.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _ids(path: str) -> Callable:
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_pieces = coder(path)
        for batch in batches:
            rows = [x.astype(np.int32) for x in with_pieces.rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array([with_pieces.decode(x).decode() for x in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return ids


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; model: path of a SentencePiece file."""
    return in_arrow(_rows(docs), _digests(model), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int> with the end id, decoded string for each row of docs."""
    return in_arrow(_rows(docs), _ids(model), "doc_id bigint, ids array<int>, decoded string")
