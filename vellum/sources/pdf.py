"""PDF sources and sinks: files in, facts out of one pass, ledgers and JSON to folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.scalars import preflight
from vellum.session import ship

BINARY = "path string, modificationTime timestamp, length long, content binary"
_RECT = pa.struct([(k, pa.float64()) for k in ("x", "y", "width", "height")])
_KINDS: dict[str, list[tuple[str, pa.DataType]]] = {
    "source": [("reason", pa.string()), ("input_hash", pa.string())],
    "document": [("page_count", pa.int32()), ("error", pa.string()), ("is_encrypted", pa.bool_()), ("handler_supported", pa.bool_()), ("algorithm", pa.string()), ("revision", pa.int32()), ("authentication", pa.string()), ("metadata_encrypted", pa.bool_()), ("permissions", pa.int64()), ("has_acro_form", pa.bool_()), ("has_xfa", pa.bool_())],
    "page": [("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("rotation", pa.int32()), ("ruling_line_count", pa.int64()), ("font_distinct_count", pa.int64())],
    "run": [("run_id", pa.int64()), ("page", pa.int32()), ("text", pa.string()), *((k, pa.float64()) for k in ("x", "y", "width", "font_size")), ("render_mode", pa.int32()), ("is_ocr_layer", pa.bool_()), ("authoritative", pa.int32()), ("fallback", pa.int32()), ("unmapped", pa.int32()), ("space_width_em", pa.float64())],
    "image": [("ord", pa.int64()), ("page", pa.int32()), ("name", pa.string()), ("px_w", pa.int64()), ("px_h", pa.int64()), *((k, pa.float64()) for k in "abcdef"), ("filters", pa.list_(pa.string())), ("has_smask", pa.bool_()), ("has_mask", pa.bool_()), ("is_image_mask", pa.bool_())],
    "field": [("ord", pa.int64()), ("fqn", pa.string()), ("partial", pa.string()), ("label", pa.string()), ("field_type", pa.string()), ("value", pa.string()), ("is_checked", pa.bool_()), ("page", pa.int32()), ("rect", _RECT)],
    "xobject": [("ord", pa.int64()), ("page", pa.int32()), ("name", pa.string()), ("px_w", pa.int64()), ("px_h", pa.int64()), ("bits", pa.int32()), ("filters", pa.list_(pa.string())), ("codec", pa.string()), ("family", pa.string()), ("components", pa.int32()), ("decode", pa.list_(pa.float64())), ("has_smask", pa.bool_()), ("k", pa.int32()), ("columns", pa.int32()), ("black_is_1", pa.bool_()), ("byte_align", pa.bool_()), ("globals", pa.binary()), ("data", pa.binary())],
    "raster": [("ord", pa.int64()), ("page", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("samples", pa.binary()), ("error", pa.string())],
}
_SCHEMA = pa.schema([("doc_id", pa.string()), ("kind", pa.string()), *((k, pa.struct(v)) for k, v in _KINDS.items())])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.string()): "array<string>", pa.list_(pa.float64()): "array<double>", _RECT: "struct<x:double,y:double,width:double,height:double>"}
FACTS = "doc_id string, kind string, " + ", ".join(f"{k} struct<{', '.join(f'`{n}`: {_SQL[t]}' for n, t in v)}>" for k, v in _KINDS.items())
#: The kinds of facts that tables are made of.
ALL = ("document", "page", "run", "image", "field")
#: Facts of one document that are held before they are passed on.
_HELD = 5_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """All *.pdf below a folder, or one file: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The files in order of their paths' code points, without reading them."""
    return files(spark, path).select("path", "modificationTime", "length").orderBy("path")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of new files."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def gated(binary: DataFrame) -> DataFrame:
    """Adds ``gate``: why a file can't be a document, by its first and last bytes."""
    return binary.withColumn("gate", preflight(F.col("content")))


def facts(binary: DataFrame, password: str | None = None, facets: tuple[str, ...] = ALL, hashed: bool = False) -> DataFrame:
    """Fact rows of the documents in (doc_id, content): one pass over the bytes for the gate, the hash (if
    ``hashed``) and the kernel, whichever facets are wanted; only the wanted ones cross back. Each file has a row
    of kind "source"; the bytes of those that fail the gate never leave the JVM."""
    from vellum.kernel.facts import analyze

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[str], list[dict]]] = {}

        def sent(kind: str) -> pa.RecordBatch:
            """One kind's rows; the other kinds' columns are null."""
            ids, rows = held.pop(kind)
            own = lambda t: pa.StructArray.from_arrays([pa.array([r[n] for r in rows], x) for n, x in t], fields=[pa.field(n, x) for n, x in t])
            columns = [own(t) if k == kind else pa.nulls(len(ids), pa.struct(t)) for k, t in _KINDS.items()]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([kind] * len(ids), pa.string()), *columns], schema=_SCHEMA)

        for batch in batches:
            for i, c, reason, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = {"source": [{"reason": reason, "input_hash": h}]}
                if reason is None:
                    found |= {k: v for k, v in analyze(c.as_py() or b"", password, facets).items() if k in facets}
                for kind, rows in found.items():
                    for begin in range(0, len(rows), _HELD):
                        ids, all_rows = held.setdefault(kind, ([], []))
                        part = rows[begin : begin + _HELD]
                        ids += [i] * len(part)
                        all_rows += part
                        if len(ids) >= _HELD:
                            yield sent(kind)
        for kind in list(held):
            yield sent(kind)

    ship(binary.sparkSession)
    g = gated(binary.select(F.col("doc_id").cast("string").alias("doc_id"), "content"))
    h = F.sha2("content", 256) if hashed else F.lit(None).cast("string")
    return g.select("doc_id", F.when(F.col("gate").isNull(), F.col("content")).alias("content"), "gate", h.alias("input_hash")).mapInArrow(run, FACTS)


def split(rows: DataFrame, kind: str) -> DataFrame:
    """One kind's facts as a table with doc_id."""
    return rows.where(F.col("kind") == kind).select("doc_id", f"{kind}.*")
