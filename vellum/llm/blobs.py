"""Shuffles of numeric columns in bulk: a row is a bucket's share of many entries, with packed arrays as binary
columns. Millions of small records cost the JVM a few thousand rows. Entries carry all that they need, so the
bytes shuffled don't depend on the number of buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a bucket's row should have on average, and bytes held at most until rows are sent.
ROW = 2048
MOST = 32 << 20


def partitions(df: DataFrame) -> int:
    """The cluster's number of shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def source_bytes(df: DataFrame) -> int:
    """Bytes of the columns in use, as Catalyst estimates them from the files; counted where it can't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return int(df.selectExpr("sum(length(text)) AS n").collect()[0][0] or 0)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: ``values`` cut at ``bounds``."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values.view(np.uint8))])


def scatter(bucket: np.ndarray, arrays: list[np.ndarray | None], names: list[str]) -> pa.RecordBatch:
    """One row for each bucket that has entries; None is a column of nulls."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    b = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    bounds = np.append(edge, len(b))
    return pa.RecordBatch.from_arrays([pa.array(b[edge].astype(np.int32)), *(pa.nulls(len(edge), pa.binary()) if a is None else packed(a[order], bounds) for a in arrays)], ["bucket", *names])


class Outbox:
    """Entries of a task, held until the rows of ``n`` buckets are worth sending."""

    def __init__(self, n: int):
        self.bytes, self.held, self.full = 0, [], min(max(n * ROW, 8 << 20), MOST)

    def add(self, *arrays: np.ndarray) -> bool:
        """True if it is time to ``take``."""
        self.held.append(arrays)
        self.bytes += sum(a.nbytes for a in arrays)
        return self.bytes >= self.full

    def take(self) -> list[np.ndarray] | None:
        """All entries; nothing is held any more."""
        held, self.held, self.bytes = self.held, [], 0
        return [np.concatenate(x) for x in zip(*held)] if held and any(len(x[0]) for x in held) else None


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of each run of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(values)))


def arrays(column: pa.Array, dtype: type) -> list[np.ndarray]:
    """A view of each value of a binary column; nulls are empty."""
    return [np.frombuffer(x.as_buffer() or b"", dtype) for x in column]


def joined(batches: list[pa.RecordBatch], name: str, dtype: type) -> np.ndarray:
    """All values of a binary column, one after another."""
    return np.concatenate([*(a for b in batches for a in arrays(b.column(name), dtype)), np.zeros(0, dtype)])


def by_text(text: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(text, its values ...) for each run of equal texts after a stable sort."""
    order = np.argsort(text, kind="stable")
    text = text[order]
    edge, size = runs(text)
    cut = [v[order] for v in values]
    for a, n in zip(edge.tolist(), size.tolist()):
        yield (int(text[a]), *(v[a : a + n] for v in cut))
