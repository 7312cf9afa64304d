"""Edit distances of many pairs of texts at once, in characters and in words; all are exact."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Unicode's white space, by code; all others are no white space.
_WHITE = np.zeros(0x3002, bool)
_WHITE[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def levenshtein(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences: a column of the table is two whole numbers of as many bits as the shorter one
    has places, for rises and falls, and goes on to the next by a few operations on them (Myers; Hyyrö)."""
    if len(a) > len(b):
        a, b = b, a
    begin, end = 0, 0
    while begin < len(a) and a[begin] == b[begin]:
        begin += 1
    while end < len(a) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not len(a):
        return len(b)
    n = score = len(a)
    full, last, at = (1 << n) - 1, 1 << n - 1, {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    masks = {x: _bits(places, n) for x, places in at.items()}
    rise, fall = full, 0
    for x in b:
        same = masks.get(x, 0)
        down = same | fall
        across = (((same & rise) + rise) ^ rise) | same
        up, low = fall | full & ~(across | rise), rise & across
        score += 1 if up & last else -1 if low & last else 0
        up, low = up << 1 | 1, low << 1
        rise, fall = (low | ~(down | up)) & full, up & down & full
    return score


def _bits(places: list[int], n: int) -> int:
    out = bytearray((n + 7) // 8)
    for i in places:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def distances(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Edit distances of n pairs of sequences; ``a`` and ``b`` have their codes one after the other. Of two as long
    as each other, places that differ are never fewer than edits, and what of their elements is in one only never
    more: where both say the same that is the distance. All other pairs are worked out."""
    n = len(a_len)
    out, open_ = np.zeros(n, np.int64), a_len != b_len
    row = np.repeat(np.arange(n), a_len)[np.repeat(~open_, a_len)]
    x, y = a[np.repeat(~open_, a_len)].astype(np.int64), b[np.repeat(~open_, b_len)].astype(np.int64)
    differ = x != y
    row, x, y = row[differ], x[differ], y[differ]
    if len(row):
        size = int(max(x.max(), y.max())) + 1
        keys, at = np.unique(np.concatenate([row * size + x, row * size + y]), return_inverse=True)
        more = np.bincount(at[: len(row)], minlength=len(keys)) - np.bincount(at[len(row) :], minlength=len(keys))
        out = np.bincount(row, minlength=n)
        alone = np.bincount(keys // size, np.maximum(more, 0), n).astype(np.int64)
        open_ = open_ | (alone != out)
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    for i in np.flatnonzero(open_):
        out[i] = levenshtein(a[a_end[i] - a_len[i] : a_end[i]].tolist(), b[b_end[i] - b_len[i] : b_end[i]].tolist())
    return out


def measures(references: list[str], hypotheses: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edits of characters, characters, edits of words, words) of each pair; lengths are the references'. Words
    stand between Unicode white space."""
    n, texts = len(references), references + hypotheses
    size = np.fromiter(map(len, texts), np.int64, 2 * n)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    half = int(size[:n].sum())
    edits = distances(chars[:half], size[:n], chars[half:], size[n:])
    white = _WHITE[np.minimum(chars, 0x3001)]
    before = np.concatenate([[True], white[:-1]])[: len(chars)]
    before[(np.cumsum(size) - size)[size > 0]] = True
    first = before & ~white
    words = np.bincount(np.repeat(np.arange(2 * n), size)[first], minlength=2 * n)
    ends = np.append((np.cumsum(~white) - 1)[first], np.count_nonzero(~white)) * 4
    each = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(chars[~white].tobytes())])
    codes = each.dictionary_encode().indices.to_numpy()
    half = int(words[:n].sum())
    return edits, size[:n], distances(codes[:half], words[:n], codes[half:], words[n:]), words[:n]
