"""Exact n-gram Jaccard self-join with set relations: skipping in index lists, and answers by difference.

A document is the set of its word trigrams; two sets are alike with a Jaccard similarity of ``THRESHOLD`` at
least. ``links`` has one row for each document: the class of all documents that are connected with it, and how
many other sets are alike. ``pairs`` has the pairs themselves. The steps:

1. Equal sets are one set, for which the document with the least doc_id stands; the others are its copies.
   Copies are counted, never gathered, and meet their set's answers in a join that broadcasts the few largest.
2. A set with a partner has at least THRESHOLD of its trigrams in some other set. All trigrams of all
   documents are shuffled and counted, those that two of one task have by the task itself; sets of which fewer are
   shared have no partner and go. Nothing is sampled. The texts of those left are read again, through a filter of
   ``MARKS`` bits.
3. Prefix index of the sets left: trigrams are ordered from rare to frequent, by counts over all documents in a
   table of ``COUNTERS`` counters, then by hash. The first |x| - ceil(t |x|) + 1 of each set go into index lists,
   shuffled by trigram, under the set's digest. A list is in order of set size, in blocks; a block is skipped as a
   whole if its sizes are out of range, and entries by position: what is left of either set after the trigram
   bounds the overlap. A list of more than ``HOT`` sets makes no pairs there. Its entries meet again with all such
   lists of their sets, and each pair comes from the first list that both are in: rows and memory follow the pairs,
   not pairs times trigrams. Lists of more than ``CUT`` sets are cut into shares by the hash of the ids, and each
   two shares meet in a bucket of their own. Trigrams whose counter is above ``LONG`` may be in very many sets;
   their entries are never together before they are cut.
4. The counts of a pair are added up, and it stays only if its common prefix and all that may follow can reach
   the threshold.
5. Pairs come together with their sets, by the least neighbour of their first set: a family of similar sets
   is in one place. One set of it, the pivot, is compared with all others; the answers of each other set
   follow from the pivot's and from what it has more and less than the pivot, without reading whole sets:
   |x & y| = |p| - |p-x| - |p-y| + |(p-x) & (p-y)| + |(x-p) & (y-p)|. For ``links`` a task returns a row for each
   set, with its number of links and another set of its component, not the pairs.

Sets are compared by 64-bit hashes of their trigrams. A text of one or two words is one shingle. With ``probes``
step 2 takes a sample of the trigrams and loses a pair with a probability of less than 1e-4; no query does so.

6. Classes are the connected components of the pairs, by alternating stars; copies have their set's class.

Defined results: null and empty texts and texts without words are in no pair, and in a class of their own with
no links; a null doc_id has no row; a doc_id that occurs in several rows counts once, with its first text in
order; pairs are (less, greater) doc_id, each once. Other columns are ignored by ``links`` and ``pairs`` and kept
by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import blobs
from vellum.llm.text_kernel import chunks, mix, ngram_hashes, word_hashes
from vellum.session import free_name, ship, tidy, written

SHINGLE = 3
THRESHOLD = Fraction(3, 5)
PROBES: int | None = None
SHARE = 0.36
COUNTERS = 1 << 20
BLOCK = 64
#: Sets of a family that one task compares at most, and the trigrams of these; larger families are cut into blocks
#: of this many.
FAMILY, GRAMS = 1024, 4 << 20
#: Entries that an index list may have in one task; sets of a list from which its pairs are made once for all such
#: lists; the sets that these have in one task; pairs that a task counts at a time; and sets compared at a time.
LONG, HOT, CUT, HELD, _STEP = 200_000, 128, 4096, 4_000_000, 512
#: Bits of the filter in front of the texts' shuffle.
MARKS = 1 << 24
_CHUNK = 1 << 20
#: Entries that one bucket of a shuffle is expected to hold, whatever the cluster's number of partitions.
BUCKET = 2_000_000


def _ceil(t: Fraction, n: np.ndarray) -> np.ndarray:
    """Least integers of t n at least, without rounding errors."""
    return -(-np.asarray(n, np.int64) * t.numerator // t.denominator)


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, sorted distinct shingles of all documents one after another, offsets)."""
    ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    grams, offsets = ngram_hashes(*word_hashes(part.column("text")), SHINGLE)
    text = np.repeat(np.arange(len(ids)), np.diff(offsets))
    order = np.lexsort((grams, text)) if len(ids) > 2000 else np.concatenate([offsets[i] + np.argsort(grams[offsets[i] : offsets[i + 1]]) for i in range(len(ids))] or [np.zeros(0, np.int64)]).astype(np.int64)
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return ids, grams, np.searchsorted(text, np.arange(len(ids) + 1))


def _digest(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of each set's hashes."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams))])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(0x5DEECE66D)))])
    return (a[offsets[1:]] - a[offsets[:-1]]).view(np.int64), (b[offsets[1:]] - b[offsets[:-1]]).view(np.int64)


def _digests(probes: int | None):
    """A row for each document (two hash sums of its set, its size, how many trigrams it tests and gives) and
    the task's counters, in 64 parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                ids, grams, offsets = _sets(part)
                size = np.diff(offsets)
                counts += np.bincount((grams & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                a, b = _digest(grams, offsets)
                tested, given = (_sizes(x, offsets) for x in _chosen(probes, grams, size))
                none = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, a, b, size.astype(np.int64), tested, given)] + [*none], _DIGEST)
        if counts.any():
            cut = np.minimum(counts, 2**32 - 1).astype(np.uint32).reshape(64, -1)
            none = pa.nulls(64, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 6 + [pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], _DIGEST)

    return run


_DIGEST = ["doc_id", "a", "b", "n", "tested", "given", "part", "counts"]


def _sizes(chosen: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many entries of each set are chosen."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(chosen)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column("part").to_pylist(), blobs.arrays(b.column("counts"), np.uint32)):
            total[k] = total[k] + c if k in total else c.astype(np.uint64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])


def _classes(parts: DataFrame) -> tuple[np.ndarray, float]:
    """(each counter's frequency as a class of 0 to 255, base): class c is of up to base 2^(c / 8)."""
    table = np.zeros((64, COUNTERS // 64), np.float64)
    rows = parts.where("part IS NOT NULL").select("part", "counts").repartitionById(64, F.col("part")).mapInArrow(_add, "part int, counts binary").collect()
    for r in rows:  # 64 rows, whatever the corpus
        table[r[0]] = np.frombuffer(r[1], np.uint64)
    table = table.reshape(-1)
    base = max(table.mean() * 1.5, 2.0)
    return np.clip(np.ceil(np.log2(np.maximum(table, 1) / base) * 8), 0, 255).astype(np.uint8), base


def _bounds(size: np.ndarray, probes: int) -> np.ndarray:
    """log2 of the share of hashes that a set of this size tests: a step function, so that sets of like
    sizes test like trigrams."""
    return np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / probes))).astype(np.int64)


def _chosen(probes: int | None, grams: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tested, given): which trigrams of each set are tested, and which are shuffled so that other sets' tests
    find them."""
    if probes is None:
        return np.ones(len(grams), bool), np.ones(len(grams), bool)
    # A set's trigrams serve partners down to THRESHOLD of its size, whose bound is wider.
    own, wide = _bounds(size, probes), _bounds(_ceil(THRESHOLD, size), probes)
    h = mix(grams)
    return _below(h, np.repeat(own, size)), _below(h, np.repeat(wide, size))


def _below(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (h & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))) == 0


#: What a probe's entry is: given only, tested too, or known to be in two documents.
_GIVEN, _TESTED, _KNOWN = 0, 1, 2
_PROBE = "bucket int, hashes binary, ids binary, kinds binary, shared binary"


def _probes(probes: int | None, n: int):
    def send(h: np.ndarray, d: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of a hash that two documents of this task have, one entry goes on, marked; the documents' shared
        trigrams are counted here."""
        order = np.argsort(h)
        h, d, k = h[order], d[order], k[order]
        edge, size = blobs.runs(h)
        both = np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)
        inside = np.repeat(both, size)
        docs, count = np.unique(d[inside & (k == _TESTED)], return_counts=True)
        k[edge[both]] = _KNOWN
        go = ~inside
        go[edge[both]] = True
        go = np.flatnonzero(go)[np.argsort(order[go])]  # set by set again, so that ids compress
        names = _PROBE.replace(" binary", "").replace("bucket int, ", "").split(", ")
        yield blobs.scatter(blobs.buckets_of(h[go], n), [(mix(h[go]) >> np.uint64(32)).astype(np.uint32), d[go], k[go], None], names)
        if len(docs):
            yield blobs.scatter(blobs.buckets_of(mix(docs.view(np.uint64)), n), [None, docs, None, count.astype(np.int32)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = blobs.Outbox(n)
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                ids, grams, offsets = _sets(part)
                size = np.diff(offsets)
                tested, given = _chosen(probes, grams, size)
                if box.add(grams[given], np.repeat(ids, size)[given], tested[given].astype(np.uint8)):
                    yield from send(*box.take())
        if (last := box.take()) is not None:
            yield from send(*last)

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shared): how many of the document's tested trigrams in this partition another one has too.
    Of a hash 32 bits beside the bucket are compared: two that seem equal may keep a set, and lose none."""
    parts = list(batches)
    h, k = blobs.joined(parts, "hashes", np.uint32), blobs.joined(parts, "kinds", np.uint8)
    counted = [i for b in parts for i, c in zip(blobs.arrays(b.column("ids"), np.int64), b.column("shared")) if c.is_valid]
    count = blobs.joined(parts, "shared", np.int32)
    d = np.concatenate([*(i for b in parts for i, c in zip(blobs.arrays(b.column("ids"), np.int64), b.column("shared")) if not c.is_valid), np.zeros(0, np.int64)])
    del parts
    order = np.argsort(h)
    h, d, k = h[order], d[order], k[order]
    if len(h):
        edge, size = blobs.runs(h)
        both = (np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)) | (np.maximum.reduceat(k, edge) == _KNOWN)
        d = d[np.repeat(both, size) & (k == _TESTED)]
    docs, at = np.unique(np.concatenate([*counted, d]), return_inverse=True)
    total = np.bincount(at.reshape(-1), np.concatenate([count, np.ones(len(d))]), len(docs))
    if len(docs):
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(total.astype(np.int32))], ["doc_id", "shared"])


def _set_rows(classes):
    """(doc_id, n, keys): the set in its global order, as sorted keys: class of frequency, then hash. It goes by
    its digest in place of a doc_id. Of a doc_id with several texts only the one whose set counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                _, grams, offsets = _sets(part)
                a, b = _digest(grams, offsets)
                keep = np.flatnonzero((a == part.column("a").to_numpy()) & (b == part.column("b").to_numpy()))
                k = classes.value[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                keys = (k << np.uint64(56)) | (mix(grams) >> np.uint64(8))
                rows = [np.sort(keys[offsets[i] : offsets[i + 1]]).tobytes() for i in keep.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(np.diff(offsets)[keep].astype(np.int64)), pa.array(rows, pa.binary())], ["doc_id", "n", "keys"])

    return run


_ENTRIES = ["keys", "ids", "sizes", "places"]
#: An entry's side in a list, in the two high bits of its place: it meets those of the other side, or all.
_SIDE, _ALL = 30, 2


def _prefix(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(key, doc_id, size, place) of what the sets of a batch give to the index."""
    ids = part.column("doc_id").to_numpy().astype(np.int64)
    size = part.column("n").to_numpy().astype(np.int64)
    length = size - _ceil(THRESHOLD, size) + 1
    flat = np.concatenate([*(k[:m] for k, m in zip(blobs.arrays(part.column("keys"), np.uint64), length.tolist())), np.zeros(0, np.uint64)])
    text = np.repeat(np.arange(len(ids)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    return flat, ids[text], size[text].astype(np.uint32), place.astype(np.uint32)


def _cut(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, long: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries with those of long lists once for each share that theirs meets, under a key of the two shares."""
    every = places | np.uint32(_ALL << _SIDE)
    if not len(long):
        return keys, ids, sizes, every
    at = np.minimum(np.searchsorted(long, keys), len(long) - 1)
    hot = np.flatnonzero(long[at] == keys)
    many = shares[at[hot]].astype(np.int64)
    own = (mix(ids[hot].view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
    entry = np.repeat(np.arange(len(hot)), many)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    own, many, hot_of = own[entry], many[entry], hot[entry]
    pair = np.minimum(own, other) * many + np.maximum(own, other)
    key = mix(keys[hot_of] ^ mix((pair + 1).astype(np.uint64)))
    side = np.where(own == other, _ALL, (own > other).astype(np.int64)).astype(np.uint32)
    rest = np.ones(len(keys), bool)
    rest[hot] = False
    both = ((keys[rest], key), (ids[rest], ids[hot_of]), (sizes[rest], sizes[hot_of]), (every[rest], places[hot_of] | side << np.uint32(_SIDE)))
    return tuple(np.concatenate(x) for x in both)


def _prefixes(n: int, often: int):
    """Index entries of the sets, by trigram. A trigram of a class from ``often`` on may be in very many sets: its
    entries are spread over all buckets, marked, and none of these makes pairs."""

    def send(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        spread = (keys >> np.uint64(56)) >= often
        bucket = blobs.buckets_of(mix(keys ^ np.where(spread, mix(ids.view(np.uint64)), np.uint64(0))), n)
        return blobs.scatter(bucket, [keys, ids, sizes, places | (spread.astype(np.uint32) << np.uint32(_SIDE))], _ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = blobs.Outbox(n)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                if box.add(*_prefix(batch.slice(begin, 2000))):
                    yield send(*box.take())
        if (last := box.take()) is not None:
            yield send(*last)

    return run


def candidates(d: np.ndarray, size: np.ndarray, place: np.ndarray, t: Fraction = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one index list, which is in order of set size. Blocks of BLOCK entries are skipped
    by their least and greatest size, the most that follows a place in them, and their greatest place, before
    which two sets may have as much in common; what is left is tested entry by entry."""
    n = len(d)
    ratio = t / (1 + t)
    starts = np.arange(0, n, BLOCK)
    low, high = size[starts], size[np.minimum(starts + BLOCK, n) - 1]
    most, deep = np.maximum.reduceat(size - place, starts), np.maximum.reduceat(place, starts)
    for x, a in enumerate(starts.tolist()):
        b = min(a + BLOCK, n)
        # Sizes ascend, so what follows is as large at least; it may be 1/t as large at most.
        ahead = np.flatnonzero((low[x:] * t.numerator <= high[x] * t.denominator) & (_ceil(ratio, low[x:] + low[x]) <= np.minimum(most[x], most[x:]) + np.minimum(deep[x], deep[x:]))) + x
        for y in ahead.tolist():
            c, e = int(starts[y]), min(int(starts[y]) + BLOCK, n)
            i, j = np.meshgrid(np.arange(a, b), np.arange(c, e), indexing="ij")
            ok = (j > i) & (size[j] * t.numerator <= size[i] * t.denominator)
            ok &= np.minimum(size[i] - place[i], size[j] - place[j]) >= _ceil(ratio, size[i] + size[j]) - np.minimum(place[i], place[j])
            if ok.any():
                yield i[ok], j[ok]


_LISTS = ["a", "b", "na", "nb", "common", "key"]


def _rows(a: np.ndarray, b: np.ndarray | None, na: np.ndarray, nb: np.ndarray, common: np.ndarray | None, key: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a[i : i + 100_000]), pa.int64()) if x is None else pa.array(x[i : i + 100_000].astype(np.int64)) for x in (a, b, na, nb, common, key)], _LISTS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, common): how many of this partition's trigrams two sets have in common in their prefixes, in
    one row or several. Of lists of more than HOT sets, and of marked entries, the entries themselves: (a, na, nb
    for the place, key)."""
    parts = list(batches)
    k, d, s, p = (blobs.joined(parts, c, t) for c, t in zip(_ENTRIES, (np.uint64, np.int64, np.uint32, np.uint32)))
    del parts
    if not len(k):
        return
    order = np.argsort(k)
    edge, length = blobs.runs(k[order])
    spread = p >> np.uint32(_SIDE) > 0
    order = order[np.repeat(length > 1, length) | spread[order]]
    k, d, s, p = k[order], d[order], s[order].astype(np.int64), (p[order] & np.uint32((1 << _SIDE) - 1)).astype(np.int64)
    spread = spread[order]
    order = np.lexsort((d, s, k))
    k, d, s, p, spread = k[order], d[order], s[order], p[order], spread[order]
    new = np.ones(len(k), bool)  # several tasks may have sent the same set
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    k, d, s, p, spread = k[new], d[new], s[new], p[new], spread[new]
    length = np.repeat(blobs.runs(k)[1], blobs.runs(k)[1]) if len(k) else np.zeros(0, np.int64)
    hot = spread | (length > HOT)
    yield from _rows(d[hot], None, s[hot], p[hot], None, k[hot].view(np.int64))
    rest = ~hot & (length > 1)
    k, d, s, p = k[rest], d[rest], s[rest], p[rest]
    if not len(k):
        return
    first, length = blobs.runs(k)
    names, dense = np.unique(d, return_inverse=True)
    dense = dense.reshape(-1).astype(np.int64)
    size_of = np.zeros(len(names), np.int64)
    size_of[dense] = s
    found: list[np.ndarray] = []
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        code, count = np.unique(np.concatenate(found), return_counts=True)
        a, b = code // len(names), code % len(names)
        yield from _rows(names[a], names[b], size_of[a], size_of[b], count, None)

    def met() -> Iterator[np.ndarray]:
        # Lists of up to 32 entries are done together: every entry with the one 1, 2, ... places after it.
        short = np.repeat(length <= 32, length)
        within, whole = np.arange(len(d)) - np.repeat(first, length), np.repeat(length, length)
        for gap in range(1, 32):
            i = np.flatnonzero(short & (within + gap < whole))
            if len(i):
                yield _codes(dense, i, i + gap, _possible(s, p, i, i + gap), len(names))
        for f, n in zip(first[length > 32].tolist(), length[length > 32].tolist()):
            for i, j in candidates(d[f : f + n], s[f : f + n], p[f : f + n]):
                yield _codes(dense, i + f, j + f, np.ones(len(i), bool), len(names))

    for codes in met():
        found.append(codes)
        held += len(codes)
        if held > HELD:
            yield from counted()
            found, held = [], 0
    if found:
        yield from counted()


def _listed(lists):
    """Rows (key, gram, id, size, place, grams) of each set for each of its hot lists, or its shares if it is cut:
    ``grams`` are all the hot lists that the set is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 50):
                batch = whole.slice(begin, 50)
                ids, size = batch.column("a").to_numpy().astype(np.int64), batch.column("na").to_numpy().astype(np.uint32)
                hot = [np.array([(x["key"], x["nb"]) for x in h], np.int64).reshape(-1, 2) for h in batch.column("hot").to_pylist()]
                blob = [np.ascontiguousarray(h[:, 0]).tobytes() for h in hot]
                n = np.array([len(h) for h in hot])
                row, flat = np.repeat(np.arange(len(ids)), n), np.concatenate(hot)
                # The share follows from the id; the row stands for it after the cut.
                keys, d, s, p = _cut(flat[:, 0].copy().view(np.uint64), ids[row], size[row], flat[:, 1].astype(np.uint32), *lists.value)
                gram = _cut(flat[:, 0].copy().view(np.uint64), ids[row], np.arange(len(flat)), flat[:, 1].astype(np.uint32), *lists.value)[2]
                for i in range(0, len(keys), 2000):
                    g = gram[i : i + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2000].view(np.int64)), pa.array(flat[g, 0]), pa.array(d[i : i + 2000]), pa.array(s[i : i + 2000].astype(np.int64)), pa.array(p[i : i + 2000].astype(np.int64)), pa.array([blob[x] for x in row[g].tolist()], pa.binary())], ["key", "gram", "id", "size", "place", "grams"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the hot lists, in order of their keys: a pair comes from the first list that both sets are in, with
    the number of all these lists. So a family of n sets gives n^2 / 2 rows, however many trigrams it shares."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        edge = np.append(blobs.runs(keys)[0], len(keys))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if held and held[0].column("key")[0].as_py() != keys[a]:
                yield from _pairs_of(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from _pairs_of(held)


def _pairs_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d, s, p = (np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in ("id", "size", "place"))
    side, p = p >> _SIDE, p & ((1 << _SIDE) - 1)
    own = held[0].column("gram")[0].as_py()
    grams = [g for b in held for g in blobs.arrays(b.column("grams"), np.int64)]
    owner = np.repeat(np.arange(len(d)), [len(g) for g in grams])
    names, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    # Lists before this one that its sets have in common: pairs that are both in the one with most come from there.
    before = (names < own) & (count > 1)
    lack = np.ones(len(d), bool)
    if before.any():
        lack[owner[column == np.argmax(np.where(before, count, 0))]] = False
    order = np.argsort(~lack, kind="stable")
    place = np.empty(len(d), np.int64)
    place[order] = np.arange(len(d))
    d, s, p, side, owner = d[order], s[order], p[order], side[order], place[owner]
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    by = np.lexsort((column, owner))
    owner, column = owner[by], column[by]
    starts = np.searchsorted(owner, np.arange(0, len(d) + _STEP, _STEP))

    def common(x: int, y: int, columns: np.ndarray) -> np.ndarray:
        """How many of these columns two sets of the blocks x and y have in common."""
        out = np.zeros((min(_STEP, len(d) - x * _STEP), min(_STEP, len(d) - y * _STEP)), np.float32)
        for c in range(0, len(columns), 4096):
            part = columns[c : c + 4096]
            m = []
            for z, n in ((x, out.shape[0]), (y, out.shape[1])):
                o, k = owner[starts[z] : starts[z + 1]], column[starts[z] : starts[z + 1]]
                at = np.minimum(np.searchsorted(part, k), len(part) - 1)
                ok = part[at] == k
                m.append(np.zeros((n, len(part)), np.float32))
                m[-1][o[ok] - z * _STEP, at[ok]] = 1
            out += m[0] @ m[1].T
        return out

    every, before = np.flatnonzero(count > 1), np.flatnonzero(before)
    for x in range(-(-int(lack.sum()) // _STEP)):
        for y in range(x, -(-len(d) // _STEP)):
            i, j = np.meshgrid(np.arange(x * _STEP, min((x + 1) * _STEP, len(d))), np.arange(y * _STEP, min((y + 1) * _STEP, len(d))), indexing="ij")
            ok = (i < j) & ((side[i] != side[j]) | (side[i] == _ALL)) & _possible(s, p, i, j)
            if ok.any() and len(before):
                ok &= common(x, y, before) == 0
            if ok.any():
                i, j, n = i[ok], j[ok], common(x, y, every)[ok]
                less = d[i] < d[j]
                i, j = np.where(less, i, j), np.where(less, j, i)
                yield from _rows(d[i], d[j], s[i], s[j], n, None)


def _possible(s: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    t = THRESHOLD
    ok = np.maximum(s[i], s[j]) * t.numerator <= np.minimum(s[i], s[j]) * t.denominator
    return ok & (np.minimum(s[i] - p[i], s[j] - p[j]) + np.minimum(p[i], p[j]) >= _ceil(t / (1 + t), s[i] + s[j]))


def _codes(dense: np.ndarray, i: np.ndarray, j: np.ndarray, ok: np.ndarray, n: int) -> np.ndarray:
    a, b = dense[i[ok]], dense[j[ok]]
    return np.minimum(a, b) * n + np.maximum(a, b)


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|x & y| of the given pairs of sorted sets. Answers come from a pivot's: each set is held as what it
    has more and less than the pivot, and overlaps of these small differences give all others."""
    size = np.array([len(x) for x in sets], np.int64)
    out = np.zeros(len(left), np.int64)
    todo = np.ones(len(left), bool)
    while todo.any():
        # The pivot: the set in most of the pairs that are left. The answers hold for any two sets, so its partners'
        # partners are done with it: between two blocks of a family no two partners of one set are a pair. Of very
        # many the rest has its turn later, so that the tables of overlaps are bounded.
        degree = np.bincount(left[todo], minlength=len(sets)) + np.bincount(right[todo], minlength=len(sets))
        pivot = int(degree.argmax())
        inside = np.zeros(len(sets), bool)
        inside[pivot] = True
        for most in (FAMILY, 2 * FAMILY):
            x, y = inside[left] & todo, inside[right] & todo
            new = np.zeros(len(sets), bool)
            new[right[x]] = new[left[y]] = True
            inside[np.flatnonzero(new & ~inside)[: most - int(inside.sum())]] = True
        near = np.flatnonzero(inside)
        p = sets[pivot]
        more, less = {}, {}
        for x in near.tolist():
            at = np.minimum(np.searchsorted(p, sets[x]), len(p) - 1)
            common = p[at] == sets[x]
            more[x] = sets[x][~common]
            have = np.zeros(len(p), bool)
            have[at[common]] = True
            less[x] = np.flatnonzero(~have)
        now = np.flatnonzero(todo & inside[left] & inside[right])
        where = np.full(len(sets), -1)
        where[near] = np.arange(len(near))
        both = _overlaps([more[x] for x in near.tolist()])
        both += _overlaps([less[x].astype(np.uint64) for x in near.tolist()])
        lack = np.array([len(less[x]) for x in near.tolist()], np.int64)
        i, j = where[left[now]], where[right[now]]
        out[now] = len(p) - lack[i] - lack[j] + both[i, j]
        todo[now] = False
    assert (out <= np.minimum(size[left], size[right])).all()
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of small sets, through the lists of the elements that several have."""
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    every = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    values, column = np.unique(every, return_inverse=True)
    column = column.reshape(-1)
    many = np.bincount(column, minlength=len(values)) > 1
    back = np.cumsum(many) - 1
    keep = many[column] if len(column) else np.zeros(0, bool)
    owner, column = owner[keep], back[column[keep]]
    width = int(many.sum())
    step = max(1, (1 << 22) // max(1, n))
    for a in range(0, width, step):
        part = (column >= a) & (column < a + step)
        m = np.zeros((n, min(step, width - a)), np.float32)
        m[owner[part], column[part] - a] = 1
        for b in range(0, n, 256):
            out[b : b + 256] += (m[b : b + 256] @ m.T).astype(np.int32)
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _linked(key, sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """(doc_a, doc_b, links) of each set that has a similar one here: another one of its component here, or itself,
    and how many are similar. Pairs don't leave the task."""
    ids, x, y, _ = _alike(sets, pairs)
    links = np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
    label = np.arange(len(ids), dtype=np.int32)
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    some = links > 0
    return pa.table({"doc_a": pa.array(ids[some], pa.int64()), "doc_b": pa.array(ids[label[some]], pa.int64()), "links": pa.array(links[some], pa.int64())})


def _family(key, sets: pa.Table, pairs: pa.Table) -> pa.Table:
    ids, left, right, jaccard = _alike(sets, pairs)
    return pa.table({"doc_a": pa.array(ids[left], pa.int64()), "doc_b": pa.array(ids[right], pa.int64()), "jaccard": pa.array(jaccard, pa.float64())})


def _alike(sets: pa.Table, pairs: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, left, right, similarity) of the pairs that are alike, by the places of their sets in ``ids``."""
    ids = sets.column("doc_id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.column("keys")]
    keys = [keys[i] for i in order.tolist()]
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    known = np.isin(a, ids) & np.isin(b, ids)  # not the set of a doc_id's other text
    left, right = (np.searchsorted(ids, c[known]).astype(np.int32) for c in (a, b))
    del a, b, known
    size = np.array([len(k) for k in keys], np.int64)
    common = similar(keys, left, right)
    union = size[left] + size[right] - common
    ok = common * THRESHOLD.denominator >= union * THRESHOLD.numerator
    return ids, left[ok], right[ok], common[ok] / union[ok]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bits) of a 64th of the filter's bits."""
    bits: dict[int, np.ndarray] = {}
    for b in batches:
        h = b.column("h").to_numpy()
        for k in np.unique(h // (MARKS // 64)).tolist():
            bits.setdefault(k, np.zeros(MARKS // 64, bool))[h[h // (MARKS // 64) == k] % (MARKS // 64)] = True
    for k, x in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], ["part", "bits"])


def _marked(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            ok = (bits.value[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1
            yield b.filter(pa.array(ok.astype(bool))).select(["doc_id", "text"])

    return run


def _join(docs: DataFrame, probes: int | None, kernel=_family, kept: str = "jaccard double", long: int | None = None, rate: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one, sets, near): a row for each doc_id with its set's sums and size (null: no words), one for each
    different set with the document that stands for it and its number of copies, and what ``kernel`` makes of the
    pairs of sets. ``rate`` has no effect: lists are counted whole."""
    spark = ship(docs.sparkSession)
    least = blobs.partitions(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    digests = written(d.mapInArrow(tidy(_digests(probes)), "doc_id long, a long, b long, n long, tested long, given long, part int, counts binary"), "digests")
    table, base = _classes(digests)
    classes = spark.sparkContext.broadcast(table)  # COUNTERS bytes
    each = digests.where("doc_id IS NOT NULL")
    one = each.groupBy("doc_id").agg(F.min(F.when(F.col("n") > 0, F.struct("a", "b", "n", "tested"))).alias("s")).select("doc_id", "s.*")
    sets = one.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("tested").alias("tested"))

    given = each.agg(F.sum("given")).collect()[0][0] or 0
    m = max(least, given // BUCKET)
    probe = d.where("text IS NOT NULL").mapInArrow(tidy(_probes(probes, m)), _PROBE).repartitionById(m, F.col("bucket")).mapInArrow(tidy(_count_shared), "doc_id long, shared int")
    share = float(THRESHOLD) - 1e-9 if probes is None else SHARE
    shared = probe.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("shared").alias("shared"))
    chosen = written(sets.join(shared, "rep").where(F.col("shared") >= F.col("tested") * share).select(F.col("rep").alias("doc_id"), "a", "b"), "chosen")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    bits = np.zeros(MARKS // 8, np.uint8)
    for r in chosen.select(h.alias("h")).repartitionById(64, (F.col("h") / F.lit(MARKS // 64)).cast("int")).mapInArrow(_marks, "part int, bits binary").collect():
        bits.reshape(64, -1)[r[0]] = np.frombuffer(r[1], np.uint8)
    marked = d.where("text IS NOT NULL").withColumn("h", h).mapInArrow(_marked(spark.sparkContext.broadcast(bits)), "doc_id long, text string")
    # Always a merge: with a broadcast both kernels would stand in one stage, with a worker each for every task.
    rows = marked.join(chosen.hint("merge"), "doc_id").select("doc_id", "text", "a", "b")
    table = written(rows.mapInArrow(tidy(_set_rows(classes)), "doc_id long, n long, keys binary").dropDuplicates(["doc_id"]), "sets")

    entries = int(table.agg(F.sum(F.col("n") - F.ceil(F.col("n") * float(THRESHOLD)) + 1)).collect()[0][0] or 0)
    m = max(least, entries // BUCKET)
    # A counter holds as many as each of its trigrams' lists at least.
    often = next((c for c in range(256) if base * 2 ** (c / 8) > max(long or LONG, 16 * base)), 256)
    listed = table.mapInArrow(tidy(_prefixes(m, often)), "bucket int, keys binary, ids binary, sizes binary, places binary").repartitionById(m, F.col("bucket"))
    lists = written(listed.mapInArrow(tidy(_index), "a long, b long, na long, nb long, common long, key long"), "lists")

    hot = lists.where("key IS NOT NULL").select("a", "na", "nb", "key").distinct()
    cut = max(long or CUT, entries // 1_000_000)
    found = sorted((r[0] % 2**64, -(-r[1] // cut)) for r in hot.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cut).collect())
    found = spark.sparkContext.broadcast((np.array([k for k, _ in found], np.uint64), np.array([n for _, n in found], np.int64)))
    of = hot.groupBy("a", "na").agg(F.sort_array(F.collect_list(F.struct("key", "nb"))).alias("hot"))
    rows = of.mapInArrow(tidy(_listed(found)), "key long, gram long, id long, size long, place long, grams binary")
    once = rows.repartition(least, "key").sortWithinPartitions("key").mapInArrow(tidy(_once), "a long, b long, na long, nb long, common long, key long")
    counted = lists.where("key IS NULL").unionByName(once)
    t = float(THRESHOLD)
    # What the prefixes don't have in common follows the prefix that ends first in the order: either set's.
    rest = F.greatest(*(F.ceil(F.col(c) * t - 1e-9) - 1 for c in ("na", "nb")))
    possible = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common")).where(F.col("common") + rest >= (F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-6).select("a", "b", "na", "nb")
    possible = written(possible, "candidates")

    both = possible.select("a", "b", F.col("nb").alias("n")).unionByName(possible.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("na").alias("n")))
    nearest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("family"), F.count("*").alias("near"), F.sum("n").alias("grams"))
    placed = possible.join(nearest, "a")
    cut = F.greatest(F.ceil(F.col("near") / F.lit(FAMILY)), F.ceil(F.col("grams") / F.lit(GRAMS))).cast("int")
    slot = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    blocks = placed.groupBy("family").agg(F.max(cut).alias("blocks"))
    placed = placed.select("a", "b", "family").join(blocks, "family").select("family", slot("a").alias("x"), slot("b").alias("y"), "a", "b")
    members = placed.select("family", "x", "y", F.explode(F.array("a", "b")).alias("doc_id")).distinct().toDF("f", "p", "q", "doc_id")
    held = members.join(table.select("doc_id", "keys"), "doc_id")
    near = held.groupBy("f", "p", "q").cogroup(placed.groupBy("family", "x", "y")).applyInArrow(kernel, f"doc_a long, doc_b long, {kept}")
    # Sets go by their digests so far.
    name = lambda c: chosen.select(F.col("a").alias(c), F.col("doc_id").alias(f"{c}_id"))
    near = near.join(name("doc_a"), "doc_a").join(name("doc_b"), "doc_b").drop("doc_a", "doc_b")
    return one, sets, near


def _assign(one: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    """``one`` with the columns of its set's row in ``classes``, null where it has none. Sets of more than one
    4,096th of all documents, which are fewer than 4,096, are broadcast: a group of copies may hold a third of
    all rows, and none of these is shuffled by its set."""
    key = ["a", "b", "n"]
    most = max(1000, one.count() // 4096)
    classes = written(classes.select(*key, "copies", *names), "classes")
    hot = classes.where(F.col("copies") > most).select(*key, F.lit(True).alias("hot"), *(F.col(c).alias(f"hot_{c}") for c in names))
    alone = F.col("hot").isNotNull() | F.col("n").isNull()
    d = one.join(F.broadcast(hot), key, "left").select(
        "doc_id", F.when(alone, F.xxhash64("doc_id")).otherwise(F.col("a")).alias("a"), F.when(alone, 0).otherwise(F.col("b")).alias("b"), F.when(alone, -1).otherwise(F.col("n")).alias("n"), *(f"hot_{c}" for c in names)
    )
    d = d.join(classes.where(F.col("copies") <= most).drop("copies"), key, "left")
    return d.select("doc_id", *(F.coalesce(f"hot_{c}", c).alias(c) for c in names))


def pairs(docs: DataFrame, probes: int | None = -1, **lists: int) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: one row for each pair of different sets, by the documents that
    stand for them, and one for each further document of a set, with the one that stands for it."""
    one, sets, near = _join(docs, PROBES if probes == -1 else probes, **lists)
    twins = _assign(one, sets.where("copies > 1"), ["rep"]).where("doc_id <> rep")
    near = near.select(F.least("doc_a_id", "doc_b_id").alias("doc_a"), F.greatest("doc_a_id", "doc_b_id").alias("doc_b"), "jaccard")
    return near.unionByName(twins.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")))


def links(docs: DataFrame, probes: int | None = -1) -> DataFrame:
    """(doc_id, class_id, n_links), one row for each doc_id: the least doc_id of all that it is connected with
    by pairs and equal sets, its own if with none, and the number of other sets that are similar to its own."""
    one, sets, near = _join(docs, PROBES if probes == -1 else probes, _linked, "links long")
    near = written(near.select(F.col("doc_a_id").alias("doc_a"), F.col("doc_b_id").alias("doc_b"), "links"), "near")
    degree = near.groupBy(F.col("doc_a").alias("rep")).agg(F.sum("links").alias("n_links"))
    known = sets.join(degree, "rep", "left").join(groups(near).withColumnRenamed("doc_id", "rep"), "rep", "left").where("copies > 1 OR n_links > 0")
    known = known.withColumn("class_id", F.coalesce("root", "rep")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return _assign(one, known, ["class_id", "n_links"]).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def groups(edges: DataFrame) -> DataFrame:
    """(doc_id, root) of every document in a pair: root is the least doc_id of its connected component.
    Each round gives a document the least root of its neighbours' and follows roots once; labels of a
    component of any diameter settle after about log2 of it rounds. Every round is a written table."""
    e = written(edges.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).where("u <> v"), "edges")
    while True:
        # Large star, then small star: every node links to the least of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.unionByName(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        if small.exceptAll(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()).isEmpty() and small.count() == e.count():
            break
        e = small
    return small.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("doc_id"), "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which no like one with a lesser doc_id is in the same
    group: one of each connected group of pairs stays, and every document that is in no pair. A doc_id that
    occurs in several rows keeps them all."""
    name = free_name("gone", docs.columns)
    drop = links(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(name))
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(name), "left_anti")
