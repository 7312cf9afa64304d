"""Token ids as binary: frequency ranks in byte-aligned codes with separate control bytes.

Texts are encoded by a byte-level BPE vocabulary file. Ids are ranked by how often they occur over all
documents (ties by id), so the most frequent 256 take one byte, the next 65,280 two. Four ranks share a control
byte with their lengths in two bits each; the data bytes lie apart. Both are decoded by look-ups in tables
of 256 control bytes, without a branch for any token.

``encode`` gives a row for each document and one row, with part 'ranks', of all ids in order of rank in the
same coding: with it the result can be decoded by itself.

Defined results: a null text has null n_tokens, control and data; an empty text has 0 and empty bytes; texts
of any length are one row; repeated rows count as often as they occur and give equal rows; an empty table
gives the row of ranks alone, by id. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import blobs, bpe
from vellum.session import ship, written

SCHEMA = "part string, doc_id long, n_tokens long, control binary, data binary"
_NAMES = ["part", "doc_id", "n_tokens", "control", "data"]
_SHIFT = np.array([0, 2, 4, 6], np.uint8)
#: Lengths of the four codes of each control byte, and their masks.
_LENGTH = (((np.arange(256)[:, None] >> _SHIFT) & 3) + 1).astype(np.int64)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of numbers below 2^32."""
    v = np.ascontiguousarray(values, np.uint32)
    n = len(v)
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    code[:n] = length - 1
    control = (code.reshape(-1, 4) << _SHIFT).sum(1).astype(np.uint8)
    keep = np.arange(4)[None, :] < length[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again."""
    length = _LENGTH[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    word = raw[at] | raw[at + 1] << np.uint32(8) | raw[at + 2] << np.uint32(16) | raw[np.minimum(at + 3, len(raw) - 1)] << np.uint32(24)
    return word & _MASK[length]


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.uint16 if bpe.encoding(path).n_vocab <= 1 << 16 else np.uint32
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                ids = [bpe.encode(t.as_py(), path).astype(wide).tobytes() if t.is_valid else None for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _counts(size: int, wide: type, parts: int):
    """This task's counts of all ids, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(blobs.joined([batch], "ids", wide), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in total.reshape(parts, -1)], pa.binary())], ["bucket", "counts"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), blobs.arrays(b.column(1), np.int64)):
            total[k] = total[k] + c if k in total else c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["bucket", "counts"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each document and one of the ranks. The texts are encoded once, into a table in the shared
    folder; the counts (one number for each id of the vocabulary) come from it and decide the ranks."""
    path = path or bpe.vocabulary_path()
    spark = ship(docs.sparkSession)
    n_vocab, parts = bpe.encoding(path).n_vocab, 16
    size, wide = -(-n_vocab // parts) * parts, np.uint16 if n_vocab <= 1 << 16 else np.uint32
    ids = written(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_ids(path), "doc_id long, ids binary"), "token_ids")
    rows = ids.select("ids").mapInArrow(_counts(size, wide, parts), "bucket int, counts binary").repartitionById(parts, F.col("bucket")).mapInArrow(_sum, "bucket int, counts binary").collect()
    counts = np.zeros((parts, size // parts), np.int64)
    for r in rows:
        counts[r[0]] = np.frombuffer(r[1], np.int64)
    order = np.argsort(-counts.reshape(-1)[:n_vocab], kind="stable")
    rank = np.empty(n_vocab, np.uint32)
    rank[order] = np.arange(n_vocab)
    shared = spark.sparkContext.broadcast(rank)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                out, n = [], []
                for x in part.column(1):
                    v = np.frombuffer(x.as_buffer(), wide) if x.is_valid else None
                    n.append(None if v is None else len(v))
                    out.append((None, None) if v is None else pack(shared.value[v]))
                yield pa.RecordBatch.from_arrays([pa.array(["document"] * part.num_rows), part.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], _NAMES)

    control, data = pack(order)
    ranks = spark.createDataFrame([("ranks", None, n_vocab, bytearray(control), bytearray(data))], SCHEMA)
    return ids.mapInArrow(run, SCHEMA).unionByName(ranks)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from what ``encode`` gave."""
    path = path or bpe.vocabulary_path()
    spark = ship(encoded.sparkSession)
    r = encoded.where("part = 'ranks'").first()
    shared = spark.sparkContext.broadcast(unpack(bytes(r.control), bytes(r.data), r.n_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, control, data = (batch.column(i).to_pylist() for i in (1, 2, 3))
            texts = [None if k is None else bpe.decode(shared.value[unpack(c, d, k)], path) for k, c, d in zip(n, control, data)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.where("part = 'document'").select("doc_id", "n_tokens", "control", "data").mapInArrow(run, "doc_id long, text string")
