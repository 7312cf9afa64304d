"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact verification.

Every benchmark item is a weighted set of word trigrams; a trigram weighs ln(1 + items / items that have
it), one that no item has ln(1 + items). At each position of a document stands, for each distinct item
length, a window of that many words (the whole document, where it is shorter). A window and an item are
alike if the weighted Jaccard similarity of their trigrams is ``SIMILARITY`` at least.

1. A window can only be alike if the item's trigrams in it weigh ``SIMILARITY`` times the item at least: a
   necessary condition, tested with prefix sums over all windows of all positions. No alike window is lost.
2. Windows that remain get a weighted 64-bit SimHash. Multi-index search: four blocks of 16 bits; two
   fingerprints within ``RADIUS`` differ in ``RADIUS // 4`` bits at most in some block, so a table of all
   block values that near to an item's gives every item within the radius, without exception.
3. Candidates within the radius are verified by the exact weighted similarity.

The benchmark's tables go to every executor; ``MOST_ITEMS`` checks their size, and a larger benchmark is
searched in slices of that many items. Then condition 1 is tested over the whole benchmark first, in one pass, and
only documents with windows that remain are read for each slice. Weights are counted over the whole benchmark:
their table (16 bytes a trigram of the benchmark) goes to every executor once. Workers make the block tables.

Defined results: null and empty texts, and items of fewer than three words, give no rows; repeated items
are found each under its item_id, repeated documents each on its own; of several windows of a document like
one item, the row has the most similar and of these the first. Other columns are ignored by ``matches``
and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.text_kernel import chunks, mix, ngram_hashes, word_hashes
from vellum.session import ship, tidy, written

SHINGLE = 3
SIMILARITY = 0.7
RADIUS = 19
MOST_ITEMS = 5_000
SCHEMA = "doc_id long, item_id long, first_word long, n_words long, similarity double"
_BIT = np.arange(64, dtype=np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """n x 64 of +1 and -1: the bits of each hash, mixed once more."""
    return ((mix(hashes)[:, None] >> _BIT) & np.uint64(1)).astype(np.float32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _sets(texts: list[str]) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """The items that have a trigram: their indices, numbers of words and distinct trigrams."""
    h, o = word_hashes(pa.array(texts, pa.large_string()))
    g, s = ngram_hashes(h, o, SHINGLE)
    size = np.diff(o)
    keep = [i for i in range(len(texts)) if size[i] >= SHINGLE]
    return keep, np.array([size[i] for i in keep], np.int64), [np.unique(g[s[i] : s[i + 1]]) for i in keep]


class Weights:
    """The weights of all trigrams, by counts over the whole benchmark, whose slices of texts are given."""

    def __init__(self, slices: Iterable[list[str]]):
        n, self.known, df = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for texts in slices:
            _, _, sets = _sets(texts)
            n += len(sets)
            own, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            self.known, at = np.unique(np.concatenate([self.known, own]), return_inverse=True)
            df = np.bincount(at.reshape(-1), np.concatenate([df, count]), len(self.known))
        n = max(1, n)
        self.weight = np.log1p(n / df)
        self.other = float(np.log1p(n))

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        """Each trigram's weight."""
        if not len(self.known):
            return np.full(len(hashes), self.other if len(hashes) else 0.0)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.weight[at], self.other)


class Screen:
    """The necessary condition: windows whose part of the known trigrams can make up an item of their length.
    ``sizes`` has the least weight of an item for each number of words."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, sizes: dict[int, float]):
        self.known, self.weight, self.sizes = known, weight, sorted(sizes.items())
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def windows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int, np.ndarray, np.ndarray]]:
        """(text, its trigrams, its words, starts, lengths) for each text that has such windows."""
        if not self.sizes:
            return
        h, o = word_hashes(texts)
        grams, s = ngram_hashes(h, o, SHINGLE)
        hit = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(hit):
            return
        at = np.minimum(np.searchsorted(self.known, grams[hit]), len(self.known) - 1)
        ok = self.known[at] == grams[hit]
        hit, at = hit[ok], at[ok]
        weight = np.zeros(len(grams))
        weight[hit] = self.weight[at]
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        # A window weighs no more than the longest one from the same place, in this text or beyond.
        least = min(t for _, t in self.sizes) * SIMILARITY - 1e-6
        place = np.arange(len(grams))
        far = np.minimum(place + self.sizes[-1][0], len(grams))
        place = place[sums[far] - sums[:-1] >= least]
        text = np.searchsorted(s, place, "right") - 1
        for d in np.unique(text).tolist():
            own = place[np.searchsorted(text, d) : np.searchsorted(text, d, "right")] - s[d]
            n = int(o[d + 1] - o[d])
            start, length = self._windows(sums[s[d] : s[d + 1] + 1], n, own)
            if len(start):
                yield d, grams[s[d] : s[d + 1]], n, start, length

    def _windows(self, sums: np.ndarray, n_words: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of one text from the places: each (start, length in trigrams) once."""
        starts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, total in self.sizes if n_words >= SHINGLE else ():
            m = min(k, n_words) - SHINGLE + 1
            w = place[place + m < len(sums)]
            w = w[sums[w + m] - sums[w] >= SIMILARITY * total - 1e-6]
            starts.append(w)
            lengths.append(np.full(len(w), m))
        both = np.unique(np.concatenate(starts) * np.int64(n_words + 1) + np.concatenate(lengths))
        return both // (n_words + 1), both % (n_words + 1)


class Items:
    """The tables of a benchmark or a slice of it. ``weights`` are the whole benchmark's; they don't go with
    the tables to a worker, where ``weighed`` puts them back and the blocks are made."""

    def __init__(self, ids: list[int], texts: list[str], weights: Weights | None = None):
        self.weights = weights or Weights([texts])
        keep, self.size, self.sets = _sets(texts)
        self.ids = np.array([ids[i] for i in keep], np.int64)
        known = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.total = np.array([self.weigh(x).sum() for x in self.sets])
        self.print = np.array([fingerprint((signs(x) * self.weigh(x)[:, None]).sum(0, keepdims=True))[0] for x in self.sets], np.uint64)
        self.screen = Screen(known, self.weigh(known), {int(k): float(self.total[self.size == k].min()) for k in np.unique(self.size)})
        self._blocks: list[tuple[np.ndarray, np.ndarray]] = []

    @property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of the four blocks: where each value's items begin, and the items near to each value."""
        if not self._blocks:
            masks = np.array([sum(1 << b for b in c) for k in range(RADIUS // 4 + 1) for c in combinations(range(16), k)], np.int64)
            for b in range(4):
                value = ((self.print >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                near = (value[:, None] ^ masks[None, :]).reshape(-1)
                order = np.argsort(near, kind="stable")
                start = np.searchsorted(near[order], np.arange(65_537))
                self._blocks.append((start, (order // len(masks)).astype(np.int32)))
        return self._blocks

    def __getstate__(self) -> dict:
        return self.__dict__ | {"weights": None, "_blocks": []}

    def weighed(self, weights: Weights) -> Items:
        self.weights = weights
        return self

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        return self.weights.weigh(hashes)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) whose fingerprints are within the radius."""
        found = []
        for b, (start, items) in enumerate(self.blocks):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = start[value + 1] - start[value]
            window = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(start[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
            near = np.bitwise_count(prints[window] ^ self.print[item]) <= RADIUS
            found.append(window[near] * len(self.ids) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of the best window for each text and item."""
        return [(d, *r) for d, grams, n, start, length in self.screen.windows(texts) for r in self._document(grams, n, start, length)]

    def _document(self, grams: np.ndarray, n_words: int, start: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int, float]]:
        best: dict[int, tuple[float, int, int]] = {}
        for i in range(0, len(start), 4096):
            a, b = start[i : i + 4096], length[i : i + 4096]
            prints = self._prints(grams, a, b)
            window, item = self.within(prints)
            own = np.minimum(self.size[item], n_words) - SHINGLE + 1 == b[window]  # an item has windows of its length
            for w, item in zip(window[own].tolist(), item[own].tolist()):
                x, y = np.unique(grams[a[w] : a[w] + b[w]]), self.sets[item]
                common = self.weigh(np.intersect1d(x, y, assume_unique=True)).sum()
                like = common / (self.weigh(x).sum() + self.total[item] - common)
                if like >= SIMILARITY - 1e-9 and (item not in best or like > best[item][0] + 1e-12):
                    best[item] = (float(like), int(a[w]), int(b[w]))
        return [(int(self.ids[i]), p, m + SHINGLE - 1, round(v, 6)) for i, (v, p, m) in sorted(best.items())]

    def _prints(self, grams: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Fingerprints of windows: sums of the trigrams' weighted signs over the part of the document that
        they span, from prefix sums. A trigram counts once a window, at its first place in it."""
        lo, hi = int(start.min()), int((start + length).max())
        part = grams[lo:hi]
        signed = signs(part).astype(np.float64) * self.weigh(part)[:, None]
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signed, 0)])
        out = sums[start - lo + length] - sums[start - lo]
        order = np.argsort(part, kind="stable")
        again = order[1:][part[order[1:]] == part[order[:-1]]]
        before = order[:-1][part[order[1:]] == part[order[:-1]]]
        for p, q in zip(again.tolist(), before.tolist()):
            inside = (start - lo <= q) & (start - lo + length > p)
            out[inside] -= signed[p]
        return fingerprint(out)


def _texts(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark on the driver, in slices of MOST_ITEMS items."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator()
    while part := list(islice(rows, MOST_ITEMS)):
        yield [i for i, _ in part], [t for _, t in part]


def _slices(benchmark: DataFrame) -> tuple[Broadcast, list[Broadcast], Screen]:
    """The weights of the whole benchmark, its tables in slices, and the screen of all of it. The driver holds the
    weights and one slice at a time; a benchmark of several slices is read a second time."""
    ship(benchmark.sparkSession)
    send = benchmark.sparkSession.sparkContext.broadcast
    slices = _texts(benchmark)
    first = [*islice(slices, 2)]
    if len(first) < 2:
        items = Items(*(first or [([], [])])[0])
        return send(items.weights), [send(items)], items.screen
    weights = Weights(t for _, t in chain(first, slices))
    sizes: dict[int, float] = {}
    out = []
    for ids, texts in _texts(benchmark):
        items = Items(ids, texts, weights)
        for k, total in items.screen.sizes:
            sizes[k] = min(total, sizes.get(k, total))
        out.append(send(items))
    return send(weights), out, Screen(weights.known, weights.weight, sizes)


def _screened(docs: DataFrame, screen: Screen, some: bool) -> DataFrame:
    """The documents that have windows to look at, or have none."""
    shared, at = docs.sparkSession.sparkContext.broadcast(screen), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                keep = np.full(part.num_rows, not some)
                keep[[w[0] for w in shared.value.windows(part.column(at))]] = some
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): every document and item of which some window is
    alike. Narrow passes over the documents; nothing is shuffled. With several slices one pass over all
    documents writes those with windows to look at, and each slice searches these only."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    table, slices, screen = _slices(benchmark)
    if len(slices) > 1:
        d = written(_screened(d, screen, True), "screened")
    for shared in slices:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = shared.value.weighed(table.value).search(part.column(1))
                    if rows:
                        t, i, p, n, v = zip(*rows)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array(i, pa.int64()), pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.float64())], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found = d.mapInArrow(tidy(run), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which no window is like a benchmark item. The test stands
    in the pass over the documents itself, so that their texts are not shuffled; with several slices, only
    documents with windows to look at go through all of them."""
    at = docs.columns.index("text")
    table, slices, screen = _slices(benchmark)
    out = docs if len(slices) == 1 else _screened(docs, screen, True)
    for shared in slices:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, at):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r[0] for r in shared.value.weighed(table.value).search(part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(tidy(run), docs.schema)
    return out if len(slices) == 1 else out.unionAll(_screened(docs, screen, False))
