"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces come from a public model file. Its scores are merge ranks; the unigram model takes Zipf's law for
them: the piece of rank r has the log score -ln(r + 1) - ln(H), with H the harmonic sum over all ranks. The
best segmentation is that of the highest sum of log scores; of equal sums the one whose last piece is the
longest, place by place from the end. A character that no piece covers costs ``UNKNOWN`` more than the worst
piece and is written as its UTF-8 bytes, in the model's byte pieces.

As in the file's normaliser, a blank is the marker U+2581 and a text begins with one more; nothing else is
changed. Decoding puts bytes together, makes markers blanks and takes off the first one, so every text comes
back as it was but for one case: a text's own U+2581 comes back as a blank, and ``round_trip`` is false.

No piece has the marker after another character, or a line feed (both are checked when the model is read).
So the best segmentation of a text is that of its parts, cut before markers and around line feeds; a part is
segmented once and kept. Parts can be of any length.

Defined results: a null text has null ids and no decoded check; an empty text has no ids; repeated rows give
equal results; other columns are left out of the result.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import ship, tidy

UNKNOWN = 10.0
MARK = "▁"
#: Parts that a worker keeps, the first it meets.
KEPT = 250_000
SCHEMA = "doc_id long, ids array<int>, n_pieces int, round_trip boolean"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        elif kind == 5:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        else:
            k = varint()
            value, i = data[i : i + k], i + k
        yield tag >> 3, kind, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; type 1 is a normal piece, 2 unknown, 3 control, 6 a byte."""
    out = []
    with open(path, "rb") as f:
        for field, _, value in fields(f.read()):
            if field == 1:
                p = {k: v for k, _, v in fields(value)}
                out.append((p[1].decode(), float(p.get(2, 0.0)), int(p.get(3, 1))))
    return out


def zipf(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log scores from the order of the pieces' own scores."""
    normal = sorted((i for i, p in enumerate(pieces) if p[2] == 1), key=lambda i: (-pieces[i][1], i))
    norm = math.log(sum(1 / (r + 1) for r in range(len(normal))) or 1)
    out = [0.0] * len(pieces)
    for r, i in enumerate(normal):
        out[i] = float(np.float32(-math.log(r + 1) - norm))
    return out


class DoubleArray:
    """A double-array trie over bytes: from node s by byte c to t = base[s] + c, if check[t] == s. ``value``
    is the id of the piece that ends at a node, or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for w, v in words.items():
            node = 0
            for c in w:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = v
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        free = bytearray(b"\1") * size
        free[0] = 0
        place = {0: 0}
        queue, low, hint = [0], 1, 1
        value[0] = ends[0]
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            k = kids[0]
            low = free.index(1, low)
            at = free.index(1, max(low if len(kids) == 1 else hint, k + 1))
            tries = 0
            while not all(free[at - k + c] for c in kids[1:]):
                at = free.index(1, at + 1)
                tries += 1
                if at + 512 > len(free):
                    grow = len(free)
                    base, check, value = base + [0] * grow, check + [-1] * grow, value + [-1] * grow
                    free += b"\1" * grow
            if tries > 16:  # it is crowded up to here
                hint = at
            b = at - k
            if b + 512 > len(free):
                grow = len(free)
                base, check, value = base + [0] * grow, check + [-1] * grow, value + [-1] * grow
                free += b"\1" * grow
            base[place[node]] = b
            for c in kids:
                free[b + c] = 0
                check[b + c] = place[node]
                value[b + c] = ends[children[node][c]]
                place[children[node][c]] = b + c
                queue.append(children[node][c])
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of every piece that begins at ``start``."""
        node, base, check, value = 0, self.base, self.check, self.value
        for i in range(start, len(text)):
            t = base[node] + text[i]
            if check[t] != node:
                return
            node = t
            if value[t] >= 0:
                yield i + 1, value[t]


class Model(dict):
    """Part of a text -> its ids, as bytes of little-endian int32."""

    def __init__(self, path: str):
        pieces = read_pieces(path)
        self.pieces = pieces
        self.score = zipf(pieces)
        normal = {p[0].encode(): i for i, p in enumerate(pieces) if p[2] == 1}
        for p in normal:
            s = p.decode()
            assert MARK not in s.lstrip(MARK) and "\n" not in s, "the model's pieces don't allow texts to be cut here"
        self.trie = DoubleArray(normal)
        self.bytes = [0] * 256
        for i, p in enumerate(pieces):
            if p[2] == 6:
                self.bytes[int(p[0][3:5], 16)] = i
        self.unknown = min(self.score) - UNKNOWN
        surface = [bytes([int(p[0][3:5], 16)]) if p[2] == 6 else b"" if p[2] == 3 else p[0].replace(MARK, " ").encode() for p in pieces]
        self.length = np.array([len(x) for x in surface], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def __missing__(self, part: str) -> bytes:
        out = np.array(self.viterbi(part.replace(" ", MARK).encode("utf-8", "replace")), np.int32).tobytes()
        if len(self) < KEPT and len(part) < 64:
            self[part] = out
        return out

    def viterbi(self, text: bytes) -> list[int]:
        """Ids of the best segmentation of UTF-8 bytes."""
        n = len(text)
        best = [-math.inf] * (n + 1)
        back = [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            c = text[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            node, single = 0, False
            for j in range(i, n):
                t = base[node] + text[j]
                if check[t] != node:
                    break
                node = t
                v = value[t]
                if v >= 0:
                    if j + 1 == i + width:
                        single = True
                    s = here + score[v]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, v)
            if not single and here + self.unknown > best[i + width]:
                best[i + width], back[i + width] = here + self.unknown, (i, -1)
        out: list[int] = []
        i = n
        while i:
            p, v = back[i]
            out += [v] if v >= 0 else [self.bytes[b] for b in reversed(text[p:i])]
            i = p
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, _PART.findall(" " + text.replace(MARK, " ")))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        n = self.length[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        raw = self.surface[at].tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_PART = re.compile(r" *[^ \n]+|\n| +")


@cache
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip): ids of each text, and whether decoding them gives it again. One
    narrow pass."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else m.encode(t) for t in texts]
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                n = np.array([0 if x is None else len(x) for x in ids], np.int64)
                null = pa.array([x is None for x in ids])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=null)
                size = pa.array([None if x is None else len(x) for x in ids], pa.int32())
                same = pa.array([None if x is None else m.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, size, same], ["doc_id", "ids", "n_pieces", "round_trip"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(run, model), SCHEMA)
