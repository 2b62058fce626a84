"""SentencePiece BPE encoding and decoding by a streaming Viterbi over backpointers.

A model file's merges are applied by score, the leftmost first among equals.  A sequence of pieces is the
encoding of a text exactly if each piece encodes to itself and each two neighbours encode to themselves,
so every prefix has one last piece, its backpointer.  The encoder walks a text once, keeps the
backpointers of a window of the longest piece's length, and commits ids whenever the paths of all
positions from which a piece can still start converge on one boundary.

Where no piece of the model holds two neighbours of a kind (checked on loading, such as a letter and a
space after it), all paths converge between any two of that kind; the stretches between such boundaries
are encoded by the same walk, and the ids of short ones are kept in a bounded cache.

Characters that are no piece become byte pieces.  U+2581 reads as a space, as in the model's own
normalisation; all other texts decode to themselves.

Defined cases: null and empty texts have no ids, and they round-trip; very long texts, also without any
space, are encoded whole, in a window of the same size; rows that repeat an id or a text are encoded row by row; an
empty table gives no rows; kept columns named like a result give way to it, others pass through; a null
list of ids decodes to null and an empty one to the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.llm.arrow import map_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches of up to so many characters are remembered, and so many of them.
MEMO_CHARS, MEMO_SIZE = 32, 150_000
#: Pairs of pieces whose verdict is remembered.
PAIRS = 200_000
#: Characters between two searches for a common boundary.
STRIDE = 64

IDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Cache(dict):
    """Ids of stretches: short ones are remembered, so many of them twice, as a full cache becomes the older one."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        found = self.older.get(part)
        if found is None:
            found = self.encode(part)
            if len(part) > MEMO_CHARS:
                return found
        if len(self) >= MEMO_SIZE:
            self.older = dict(self)
            self.clear()
        self[part] = found
        return found


class PieceModel:
    """A BPE piece model with byte fallback."""

    NORMAL, USER_DEFINED, BYTE = 1, 4, 6

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes: list[int] = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.silent: set[int] = set()
        for number, value in _fields(data):
            if number != 1:
                continue
            f = dict(_fields(value))
            piece, kind, i = f[1].decode(), f.get(3, self.NORMAL), len(self.pieces)
            self.pieces.append(piece)
            self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            if kind in (self.NORMAL, self.USER_DEFINED):
                self.ids[piece] = i
            elif kind == self.BYTE:
                self.bytes[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            else:
                self.silent.add(i)
        self.longest = max(map(len, self.ids))
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else p.encode() for i, p in enumerate(self.pieces)]
        ranks = {x: r for r, x in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: ranks[self.scores[i]] for p, i in self.ids.items() if len(p) > 1}
        # The lengths of the pieces of two characters or more that end with three (or are those two), longest first.
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.stretch = self._stretches()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.cache = Cache(lambda part: self.ids_of(self.stream(part)))
        self.widest = 0  # positions that a window held at most

    def _stretches(self) -> re.Pattern:
        """Cuts a text where no piece can lie across: before spaces, around line breaks, and between
        punctuation and anything else, as far as this model's pieces allow."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b == SPACE and a != SPACE or "\n" in (a, b) for a, b in pairs):
            return re.compile(r"(?s).+")
        q = set(punctuation)
        mixed = {c for x in pairs if (x[0] in q) != (x[1] in q) for c in x if c not in q and c != SPACE}
        q, m = (re.escape("".join(sorted(x))) for x in (q, mixed))
        end = f"(?![{m}])" if mixed else ""
        # A word, or punctuation, unless a character follows that pieces join to either; else up to a space.
        return re.compile(f"{SPACE}*+[^{SPACE}\n{q}{m}]++{end}|{SPACE}*+[{q}]++{end}|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text by merging the best neighbours until none is left, and the last merger."""
        parts, made = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.rank.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or k < best):
                    best, at = k, i
            if at < 0:
                return parts, made
            made = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def halves_of(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merger makes a piece; None if it is a character or never made."""
        if piece not in self.halves:
            parts, made = self.merge(piece)
            self.halves[piece] = made if len(parts) == 1 else None
        return self.halves[piece]

    def follows(self, a: str | None, b: str) -> bool:
        """Whether b may stand after a, or at the start."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = (len(b) == 1 or self.halves_of(b) is not None) and (a is None or self._apart(a, b))
        return ok

    def _apart(self, a: str, b: str) -> bool:
        """Whether no merger ever crosses from a to b.

        Mergers are undone from the latest to the first, b's before a's of the same rank, as the leftmost
        goes first.  The two parts at the boundary that stand before a merger must not merge with each
        other earlier than it.
        """
        if not a.strip(SPACE) and not b.strip(SPACE):
            return self.merge(a + b)[0] == [a, b]
        rank = self.rank
        limit, strict = len(rank) + 1, True
        while True:
            cross = rank.get(a + b)
            if cross is not None and (cross < limit or cross == limit and not strict):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, strict = ra, True
                a = self.halves_of(a)[1]
            else:
                limit, strict = rb, False
                b = self.halves_of(b)[0]

    def stream(self, chars: str, stride: int = STRIDE) -> Iterator[str]:
        """The pieces of a text, each as soon as its end is certain."""
        ids, longest, lengths, pairs, follows = self.ids, self.longest, self.lengths, self.pairs, self.follows
        base = 0  # the last committed boundary
        last: list[str | None] = [None]  # last[i - base]: the piece that ends at i
        n, i = len(chars), 0
        while i < n:
            for i in range(i + 1, min(n, i + stride) + 1):
                room = i - base
                found = chars[i - 1]
                if room > 1:
                    for size in lengths.get(chars[i - 3 : i], ()) if room > 2 else ():
                        if size <= room:
                            piece = chars[i - size : i]
                            if piece in ids:
                                before = last[room - size]
                                ok = pairs.get((before, piece))
                                if follows(before, piece) if ok is None else ok:
                                    found = piece
                                    break
                    else:
                        piece = chars[i - 2 : i]
                        if piece in ids:
                            before = last[room - 2]
                            ok = pairs.get((before, piece))
                            if follows(before, piece) if ok is None else ok:
                                found = piece
                last.append(found)
            # Of all positions from which a piece can still start, the paths are followed back to where they meet.
            open_ = {i} if i == n else set(range(max(base, i - longest + 1), i + 1))
            while len(open_) > 1:
                j = max(open_)
                open_.remove(j)
                open_.add(j - len(last[j - base]) if j > base else base)
            boundary = open_.pop()
            out, j = [], boundary
            while j > base:
                out.append(last[j - base])
                j -= len(out[-1])
            yield from reversed(out)
            self.widest = max(self.widest, len(last))
            last, base = last[boundary - base :], boundary

    def ids_of(self, pieces) -> tuple[int, ...]:
        out: list[int] = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in piece.encode()]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.cache.__getitem__, self.stretch.findall(SPACE + text.replace(" ", SPACE)))))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _shared(df: DataFrame, model: str):
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def held_model(data: bytes) -> PieceModel:
    """The model of a worker process, with its memo, for all its tasks; one at a time, so memory is bounded.

    It is held by ``sys``, as functions reach workers by value and a global of this module would be
    another one in each task.
    """
    import hashlib
    import sys

    key = hashlib.sha256(data).digest()
    held = getattr(sys, "_held_piece_model", None)
    if held is None or held[0] != key:
        held = sys._held_piece_model = (key, PieceModel(data))
    return held[1]


def encode_pieces(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``keep`` columns, the ids of each whole text, and whether they decode to it again.

    The model is read on the driver and broadcast; its size is fixed by the vocabulary.
    """
    shared = _shared(docs, model)

    def make():
        m = held_model(shared.value)

        def run(texts: pa.Array) -> list:
            rows = texts.to_pylist()
            limits, flat, same = [0], [], []
            for t in rows:
                ids = m.encode(t)
                flat += ids
                limits.append(len(flat))
                same.append(m.decode(ids) == (t or "").replace(SPACE, " "))
            return [pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(np.array(flat, np.int32))), same]

        return run

    return map_text(docs, text, IDS, make, docs.columns if keep is None else keep)


def decode_pieces(rows: DataFrame, ids: str = "ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """rows with the text of an id column, null for null."""
    shared = _shared(rows, model)

    @F.pandas_udf(T.StringType())
    def decoded(batch):
        m = held_model(shared.value)
        return batch.map(lambda x: None if x is None else m.decode(list(x)))

    return rows.withColumn(name, decoded(ids))
