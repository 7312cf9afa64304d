"""Vectorised word and shingle hashing over Arrow string batches.

A word is a maximal run of ``[a-z0-9]`` or non-ASCII characters of the lower-cased text; every other
ASCII character separates words. The same rule in RE2 syntax is ``WORD_RE``. Nulls count as empty
texts. All hashing is numpy over the concatenated bytes of a batch, so cost is a few nanoseconds a byte
and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The word rule for SQL engines with RE2 (applied to the lower-cased text).
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_B = 0x9E3779B97F4A7C15 | 1
_C = np.uint64(0xD1342543DE82EF95)
_rng = np.random.RandomState(20_240_229)
_T = _rng.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.r_[ord("a") : ord("z") + 1, ord("0") : ord("9") + 1, 128:256]] = True
#: Powers that a process keeps; more are worked out from them where they are used.
POWERS = 1 << 16
_pow: np.ndarray = np.ones(1, np.uint64)
_inv: np.ndarray = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) >= n:
        return _pow, _inv
    if len(_pow) < POWERS:
        with np.errstate(over="ignore"):
            _pow = np.multiply.accumulate(np.r_[np.uint64(1), np.full(POWERS - 1, _B, np.uint64)])
            _inv = np.multiply.accumulate(np.r_[np.uint64(1), np.full(POWERS - 1, pow(_B, -1, 1 << 64), np.uint64)])
    if n <= POWERS:
        return _pow, _inv
    rows = -(-n // POWERS)
    power, inverse = (
        np.multiply.outer(np.array([pow(int(x[1]), POWERS * i, 1 << 64) for i in range(rows)], np.uint64), x).ravel()
        for x in (_pow, _inv)
    )
    return power, inverse


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets, starting at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, n + 1 word offsets of the documents)."""
    hashes, offsets, _, _ = words(texts)
    return hashes, offsets


def words(texts: pa.Array, with_bytes: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of every word, n + 1 word offsets of the documents, byte starts, byte ends) and, on demand, the
    lower-cased bytes that these refer to."""
    n = len(texts)
    lowered = pc.utf8_lower(texts.cast(pa.large_string()))
    raw, offsets = string_bytes(pc.binary_join_element_wise(pc.fill_null(lowered, ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), none, none, *([raw] if with_bytes else [])
    inside = _IS_WORD[raw].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a text ends in a separator
    power, inverse = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_T[raw] * power[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets), starts, ends, *([raw] if with_bytes else [])


def ngram_hashes(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram of words, offsets of the documents). A document of 1 to n - 1 words has one
    shingle, of all its words; one without words has none."""
    lengths = np.diff(offsets)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    grams, c = padded[: len(hashes)].copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(1, n):
            c = c * _C
            grams += padded[j : j + len(hashes)] * c
    counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
    grams = mix(grams[at])
    for d in np.flatnonzero((lengths > 0) & (lengths < n)):
        own = hashes[offsets[d] : offsets[d + 1]]
        with np.errstate(over="ignore"):
            code = np.uint64(len(own))
            for h in own:
                code = code * _C + h
        grams[out[d]] = mix(np.array([code]))[0]
    return grams, out


def chunks(batch: pa.RecordBatch, column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes of text, or of one row, whole: work arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def span_hashes(hashes: np.ndarray, index: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of ``length`` words that begins at each index."""
    if not len(index):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[index + length] - sums[index]) * inverse[index])
