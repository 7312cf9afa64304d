"""Substring dedup by difference-cover anchors.

A passage is a run of ``LENGTH`` words or more that stands in two documents at least. ``COVER`` is a perfect
difference set modulo ``PERIOD``: for any two places there is a shift of less than PERIOD that brings both to
cover positions. So two equal runs of LENGTH words have, at the same distance from their beginnings, a
window of ``WINDOW`` = LENGTH - PERIOD + 1 words that both documents hash as an anchor; it is enough to hash
windows at the 6 of 31 positions that are in the cover.

1. Every document's anchors are shuffled by hash; those of two documents at least go back to their documents.
   A task combines first: of an anchor that two of its own documents have it sends one entry, marked, so that
   a passage in very many documents reaches its bucket as a few entries a task.
2. Each is extended: to all runs of LENGTH words around it. These runs, in documents with shared anchors
   only, are shuffled by their hash; a run in two documents at least is part of a passage.
3. A document's runs that overlap or touch are one maximal span.

Every step is linear in the anchors or runs, however many documents share one: no pairs are made.
Words are those of ``text_kernel``; words and runs are compared by 64-bit hashes.

Defined results: null and empty texts and texts of fewer than LENGTH words have no span; a passage that
stands twice in one document only, or in rows of the same doc_id, does not repeat across documents; copies
of whole documents have one span of all their words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import blobs
from vellum.llm.text_kernel import chunks, mix, span_hashes, word_hashes
from vellum.session import ship

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
LENGTH = 50
WINDOW = LENGTH - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_BLOB = "bucket int, hashes binary, ids binary, places binary, known binary"
_NAMES = ["hashes", "ids", "places", "known"]
_CHUNK = 1 << 20
#: Entries that one bucket is expected to hold.
BUCKET = 2_000_000


def _places(hashes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, text) of every run of ``length`` words that lies in one text."""
    many = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    return offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many), text


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc_id, place) of a document's windows at cover positions."""
    hashes, offsets = word_hashes(part.column("text"))
    index, text = _places(hashes, offsets, WINDOW)
    place = index - offsets[:-1][text]
    keep = _IN_COVER[place % PERIOD]
    index, text, place = index[keep], text[keep], place[keep]
    return span_hashes(hashes, index, WINDOW), _ids(part)[text], place.astype(np.uint32)


def _runs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc_id, place) of all runs of LENGTH words that contain one of the document's shared anchors."""
    hashes, offsets = word_hashes(part.column("text"))
    begins, ends = [], []
    for d, found in enumerate(part.column("found")):
        places = np.frombuffer(b"".join(found.as_py()), np.uint32).astype(np.int64) + offsets[d]
        first, end = np.maximum(places - (LENGTH - WINDOW), offsets[d]), np.minimum(places, offsets[d + 1] - LENGTH) + 1
        ok = first < end
        begins.append(first[ok])
        ends.append(end[ok])
    size = len(hashes) + 1
    marks = np.bincount(np.concatenate(begins), minlength=size) - np.bincount(np.concatenate(ends), minlength=size)
    index = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
    text = np.searchsorted(offsets, index, "right") - 1
    return span_hashes(hashes, index, LENGTH), _ids(part)[text], (index - offsets[:-1][text]).astype(np.uint32)


def _combine(h: np.ndarray, d: np.ndarray, p: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """What a task sends of the entries it holds. Of a hash that two of its documents have, one entry goes to the
    hash's bucket, marked as known to be shared, and the places go back to their documents by themselves."""
    order = np.argsort(h)
    h, d, p = h[order], d[order], p[order]
    edge, size = blobs.runs(h)
    both = np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)
    inside = np.repeat(both, size)
    send = ~inside
    send[edge[both]] = True
    yield blobs.scatter(blobs.buckets_of(h[send], n), [h[send], d[send], p[send], inside[send]], _NAMES)
    d, p = d[inside], p[inside]
    if len(d):
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        yield blobs.scatter(blobs.buckets_of(mix(d.view(np.uint64)), n), [None, d, p, None], _NAMES)


def _emit(of, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = blobs.Outbox(n)
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                if box.add(*of(part)):
                    yield from _combine(*box.take(), n)
        if (last := box.take()) is not None:
            yield from _combine(*last, n)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, places) of the hashes of this partition that are in two documents at least."""
    hashes, docs, places, marks, done = [], [], [], [], []
    for b in batches:
        for h, d, p, k in zip(*(blobs.arrays(b.column(c), t) for c, t in zip(_NAMES, (np.uint64, np.int64, np.uint32, np.bool_)))):
            if len(h):
                hashes.append(h)
                docs.append(d)
                places.append(p)
                marks.append(k)
            else:
                done.append((d, p))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    if hashes:
        h, d, p, k = (np.concatenate(x) for x in (hashes, docs, places, marks))
        del hashes, docs, places, marks
        order = np.argsort(h)
        h, d, p, k = h[order], d[order], p[order], k[order]
        edge, size = blobs.runs(h)
        both = (np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)) | np.maximum.reduceat(k, edge)
        keep = np.repeat(both, size) & ~k
        done.append((d[keep], p[keep]))
    d, p = (np.concatenate(x) for x in zip(*done, none))
    out = list(blobs.by_text(d, p))
    for i in range(0, len(out), 4096):
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[i : i + 4096]], pa.int64()), pa.array([x[1].tobytes() for x in out[i : i + 4096]], pa.binary())], ["doc_id", "places"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, first, words = [], [], []
        for d, found in zip(b.column("doc_id").to_pylist(), b.column("found")):
            p = np.unique(np.frombuffer(b"".join(found.as_py()), np.uint32).astype(np.int64))
            edge = np.flatnonzero(np.diff(p, prepend=p[0] - LENGTH - 1) > LENGTH)
            last = p[np.append(edge[1:], len(p)) - 1]
            ids += [d] * len(edge)
            first += p[edge].tolist()
            words += (last + LENGTH - p[edge]).tolist()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, first, words)], ["doc_id", "first_word", "n_words"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words) of every maximal span of each document that consists of passages."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Files hold about a word in two bytes; 6 of 31 windows are anchors. Buckets follow the data, not the cluster.
    words = blobs.source_bytes(d) // 2
    least = blobs.partitions(docs)

    def shared(rows: DataFrame, of, entries: int) -> DataFrame:
        n = max(least, entries // BUCKET)
        sent = rows.mapInArrow(_emit(of, n), _BLOB).repartitionById(n, F.col("bucket"))
        return sent.mapInArrow(_shared, "doc_id long, places binary").groupBy("doc_id").agg(F.collect_list("places").alias("found"))

    anchors = shared(d, _anchors, words * len(COVER) // PERIOD)
    runs = shared(d.join(anchors, "doc_id"), _runs, words)
    return runs.mapInArrow(_spans, "doc_id long, first_word long, n_words long")
