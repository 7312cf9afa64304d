"""Toxicity: a bag of subwords averaged into a linear softmax, trained jointly in numpy.

Every word is its character n-grams (3 to 5, with word-boundary marks) and itself; each n-gram is hashed
into a bucket with an embedding. A bag's vector is the mean of its n-grams' embeddings, and a linear softmax
over it gives the classes' logits. A text is read as bags at two levels: the whole text, and each of its
windows of ``WINDOW`` words. Its logits are those of the whole text's bag plus the mean of its ``TOP`` most
toxic windows': a long text with two abusive words isn't averaged away, and one chance likeness isn't enough.
Embeddings and softmax are trained together, on labelled documents, with the windows chosen anew each step.

The two-class softmax depends on the difference of its two rows only, and the model is linear in the
n-grams. So a word's share is a number, worked out once for each distinct word of a batch.

Bound of the sample: at most ``SAMPLE`` labelled documents of each class train, those with the least hash
of doc_id; of a doc_id in several rows, with its least text. An n-gram takes part if it is in a 150th as many labelled texts as the smaller class has, in 2 at
least and 10 at most. All documents are scored, whole; those of a score above ``THRESHOLD`` are toxic.

Defined results: null and empty texts, and texts without words, are not toxic (score 0.0 and no row among
the rejected), nor are texts without an n-gram that the model knows; documents with several, contradictory label rows count as toxic if any is 1, null labels
count as no label; repeated documents score alike; without labels of both classes, or without an
n-gram in enough labelled texts, every score is 0.0.
Other columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm.text_kernel import chunks, mix, words
from vellum.session import free_name, ship, tidy

SAMPLE = 1500
WINDOW = 3
TOP = 2
BUCKETS = 1 << 17
DIM = 8
STEPS = 60
#: An n-gram counts if it is in so many labelled texts at least: one for SPREAD of the smaller class, from 2 to 10.
SPREAD, LEAST, MOST = 150, 2, 10
DECAY = 1e-5
THRESHOLD = 0.5
MARGIN = 3.0
_C = 0x9DDFEA08EB382D69


def bags(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of words given as byte ranges of valid UTF-8: each word's n-grams of 3 to 5
    characters of ``<word>``, and the word itself."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    length = ends - starts
    at = np.cumsum(length + 2) - (length + 2)
    buffer = np.empty(int((length + 2).sum()), np.uint8)
    buffer[at], buffer[at + length + 1] = ord("<"), ord(">")
    inner = np.repeat(at + 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    buffer[inner] = raw[np.repeat(starts, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
    c = np.frombuffer(buffer.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.flatnonzero(c == ord("<"))
    size = np.diff(np.append(begin, len(c)))
    left = np.repeat(begin + size, size) - np.arange(len(c))  # characters from here to the word's end
    codes, owners = [], []
    owner = np.repeat(np.arange(n), size)
    whole = np.add.reduceat(mix(c + (left.astype(np.uint64) << np.uint64(32))), begin)
    codes.append(mix(whole))
    owners.append(np.arange(n))
    h = c.copy()
    power = 1
    for k in range(2, 6):
        power = power * _C & (1 << 64) - 1
        h = h[:-1] + c[k - 1 :] * np.uint64(power)
        if k > 2 and len(h):
            ok = np.flatnonzero(left[: len(h)] >= k)
            codes.append(mix(h[ok] + np.uint64(k)))
            owners.append(owner[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(codes)[order] & np.uint64(BUCKETS - 1)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, offsets) of the distinct words, the word at each place, n + 1 offsets of the texts."""
    hashes, offsets, starts, ends, raw = words(texts, with_bytes=True)
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return *bags(raw, starts[index], ends[index]), inverse.reshape(-1), offsets


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``distinct`` of many texts, a megabyte of them at a time: the driver has little memory."""
    places, lengths, names, ids, sizes = [], [], np.zeros(0, np.uint64), [], []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["t"])
    for part in chunks(batch, 0, 1 << 20):
        hashes, offsets, starts, ends, raw = words(part.column(0), with_bytes=True)
        places.append(hashes)
        lengths.append(np.diff(offsets))
        own, index = np.unique(hashes, return_index=True)
        new = ~np.isin(own, names)
        names = np.concatenate([names, own[new]])
        bag, first = bags(raw, starts[index[new]], ends[index[new]])
        ids.append(bag.astype(np.int32))
        sizes.append(np.diff(first))
    order = np.argsort(names)
    at = order[np.searchsorted(names[order], np.concatenate(places))]
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(ids), first, at.astype(np.int32), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the windows, which follow each other; a text's last one may be shorter."""
    length = np.diff(offsets)
    many = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), many)
    start = offsets[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return start, np.minimum(start + WINDOW, offsets[1:][text]), text


def highest(z: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each text's TOP windows (of equal ones the first), and 1 / how many these are for each."""
    order = np.lexsort((-z, text))
    first = np.searchsorted(text, text)
    keep = order[np.arange(len(z)) - first < TOP]
    many = np.minimum(np.searchsorted(text, text[keep], "right") - first[keep], TOP)
    return keep, 1 / many


@dataclass
class Model:
    """``share``: what each bucket adds to the difference of the two classes' logits; ``bias`` likewise."""

    share: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """P(toxic) of each text."""
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -800, 50)))

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The log odds; -inf, a score of 0.0, without a known n-gram."""
        out = np.full(len(texts), -np.inf)
        ids, first, at, offsets = distinct(texts)
        if not len(at):
            return out
        share = np.add.reduceat(self.share[ids], first[:-1])[at]
        some = np.flatnonzero(np.diff(offsets))
        offsets = np.append(offsets[some], offsets[-1])
        start, end, text = windows(offsets)
        s, n = np.concatenate([[0], np.cumsum(share)]), np.concatenate([[0], np.cumsum(np.diff(first)[at])])
        z = (s[end] - s[start]) / (n[end] - n[start])
        hit, part = highest(z, text)
        top = np.bincount(text[hit], z[hit] * part, len(some)) + (s[offsets[1:]] - s[offsets[:-1]]) / (n[offsets[1:]] - n[offsets[:-1]])
        known = np.add.reduceat((self.share != 0)[ids], first[:-1])[at]
        seen = np.concatenate([[0], np.cumsum(known)])
        out[some] = np.where(seen[offsets[1:]] > seen[offsets[:-1]], top + self.bias, -np.inf)
        return out


def least_texts(y: np.ndarray) -> int:
    """In how many labelled texts an n-gram has to be, by the size of the smaller class."""
    return int(np.clip(min((y == 1).sum(), (y == 0).sum()) // SPREAD, LEAST, MOST))


def train(texts: list[str], toxic: list[int], steps: int = STEPS) -> Model:
    """The model of all texts, with its bias lowered so far that clean texts, as models of the other half of the
    texts see them, lie below the threshold by MARGIN standard deviations."""
    model = learn(texts, toxic, steps)
    clean = []
    for half in (0, 1):
        other = learn(texts[half::2], toxic[half::2], steps)
        own = [t for t, y in zip(texts[1 - half :: 2], toxic[1 - half :: 2]) if not y]
        z = other.logits(pa.array(own, pa.large_string()))
        clean.append(z[np.isfinite(z)])
    z = np.concatenate(clean)
    lower = max(0.0, float(z.mean() + MARGIN * z.std())) if len(z) else 0.0
    return Model(model.share, model.bias - lower)


def learn(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 7) -> Model:
    """Embeddings and softmax by Adam on the log loss; the two classes weigh alike."""
    y = np.array(toxic, np.float64)
    share = np.zeros(BUCKETS)
    if not texts:
        return Model(share, -50.0)
    bag, first, flat, offsets = vocabulary(texts)
    some = np.diff(offsets) > 0
    y = y[some]
    if not len(y) or y.min() == y.max():
        return Model(share, -50.0)
    offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[some])])
    n_words, n_grams, first = len(first) - 1, np.diff(first), first[:-1]
    start, end, owner = windows(offsets)
    sums = np.concatenate([[0], np.cumsum(n_grams[flat])])
    size = (sums[end] - sums[start]).astype(np.float64)
    whole = (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    rng = np.random.RandomState(seed)
    E, v, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, DIM), 0.0
    mE, vE, mv, vv, mb, vb = np.zeros_like(E), np.zeros_like(E), np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    # Buckets of few texts stay at zero: what only one text has says nothing of others.
    spread = np.zeros(BUCKETS, np.int64)
    for i in range(len(y)):
        w = np.unique(flat[offsets[i] : offsets[i + 1]])
        n = n_grams[w]
        at = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        spread[np.unique(bag[at])] += 1
    used = np.flatnonzero(spread >= least_texts(y))
    if not len(used):
        return Model(share, -50.0)
    back = np.full(BUCKETS, len(used), np.int32)
    back[used] = np.arange(len(used))
    E, mE, vE, bag = E[used], mE[used], vE[used], back[bag]
    zero = np.zeros(1)
    for step in range(1, steps + 1):
        a = np.add.reduceat(np.concatenate([E @ v, zero])[bag], first)
        s = np.concatenate([[0], np.cumsum(a[flat])])
        z = (s[end] - s[start]) / size
        hit, part = highest(z, owner)
        own = owner[hit]
        top = np.bincount(own, z[hit] * part, len(y)) + (s[offsets[1:]] - s[offsets[:-1]]) / whole
        p = 1 / (1 + np.exp(-np.clip(top + b, -50, 50)))
        g = (p - y) * weight
        # Each word of a bag gets its share of g; a difference array spreads it.
        diff = np.zeros(len(flat) + 1)
        np.add.at(diff, start[hit], g[own] * part / size[hit])
        np.add.at(diff, end[hit], -g[own] * part / size[hit])
        np.add.at(diff, offsets[:-1], g / whole)
        np.add.at(diff, offsets[1:], -g / whole)
        per_word = np.bincount(flat, np.cumsum(diff)[:-1], n_words)
        per_gram = np.bincount(bag, np.repeat(per_word, n_grams), len(used) + 1)[:-1]
        gE, gv, gb = per_gram[:, None] * v + DECAY * E, per_gram @ E + DECAY * v, g.sum()
        lr, c1, c2 = 0.05, 1 - 0.9**step, 1 - 0.99**step
        mE += 0.1 * (gE - mE)
        vE += 0.01 * (gE * gE - vE)
        E -= lr * (mE / c1) / (np.sqrt(vE / c2) + 1e-7)
        mv += 0.1 * (gv - mv)
        vv += 0.01 * (gv * gv - vv)
        v = v - lr * (mv / c1) / (np.sqrt(vv / c2) + 1e-7)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
    share[used] = E @ v
    return Model(share.astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents' bounded sample."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("_y"))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "_y").collect()
    return train([r[0] for r in rows], [r[1] for r in rows])


def _scored(docs: DataFrame, model: Model, only: str) -> DataFrame:
    """The input's rows that are toxic (only='toxic') or aren't ('clean'), with all columns and last the score."""
    name = free_name("score", docs.columns)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(batch, at, 1 << 20):
                scores = model.scores(part.column(at))
                keep = pa.array((scores > THRESHOLD) == (only == "toxic"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, name]).filter(keep)

    ship(docs.sparkSession)
    schema = StructType([*docs.schema.fields]).add(name, "double")
    return docs.mapInArrow(tidy(run), schema)


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of the documents that are toxic. One narrow pass once the model is trained."""
    model = fit(docs, labels, sample)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scored(d, model, "toxic").select("doc_id", "score")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't toxic, with their columns."""
    return _scored(docs, fit(docs, labels, sample), "clean").select(*[F.col(f"`{c}`") for c in docs.columns])
