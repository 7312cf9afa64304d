"""Images to pixels: codecs, colour, and the plug-in for recognition engines. Metadata is filtered before any
pixel is decoded: ``decode`` goes on top of filters over the xobject facts."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import ship

RASTER = "doc_id string, page int, ord long, name string, width int, height int, components int, samples binary, error string"
LINES = "doc_id string, page int, ord long, text string, x double, y double, width double, height double, confidence double"
_COLUMNS = ["doc_id", "page", "ord", "name", "px_w", "px_h", "bits", "codec", "family", "components", "decode", "k", "columns", "black_is_1", "byte_align", "globals", "data"]


def pixels(r: dict) -> tuple[int, int, int, bytes]:
    """(width, height, components, samples) of one xobject fact."""
    from vellum.kernel import ccitt, color, jbig2, jpeg, jpx
    from vellum.kernel.objects import PdfError

    codec, data = r["codec"], r["data"] or b""
    if codec == "DCTDecode":
        return jpeg.decode(data)
    if codec == "CCITTFaxDecode":
        w, h, packed = ccitt.decode(data, r["k"] or 0, r["columns"] or 1728, 0, bool(r["black_is_1"]), bool(r["byte_align"]))
        n, out = color.to_rgb(packed, w, h, 1, 1, color.Space("DeviceGray", 1), r["decode"])
        return w, h, n, out
    if codec == "JBIG2Decode":
        w, h, packed, missing = jbig2.decode_page(data, r["globals"])
        if missing:
            raise PdfError("JBIG2: " + "; ".join(missing))
        n, out = color.to_rgb(bytes(255 - b for b in packed), w, h, 1, 1, color.Space("DeviceGray", 1), r["decode"])
        return w, h, n, out
    if codec == "JPXDecode":
        w, h, n, out = jpx.decode(data)
        return w, h, *jpx.plain(n, out)
    if codec:
        raise PdfError(f"unsupported image codec {codec}")
    n = {"DeviceGray": 1, "ImageMask": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(r["family"] or "", (r["components"] or 0) if r["family"] == "ICCBased" else 0)
    if n not in (1, 3, 4):
        raise PdfError(f"colour space {r['family']} needs its document")
    bits = 1 if r["family"] == "ImageMask" else r["bits"] or 8
    return r["px_w"], r["px_h"], *color.to_rgb(data, r["px_w"], r["px_h"], n, bits, color.Space({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n], n), r["decode"])


def decode(xobjects: DataFrame, most: int | None = None) -> DataFrame:
    """Pixels of each image; what can't be decoded has an error instead. ``most``: images tried a document."""
    if most is not None:
        from pyspark.sql import Window as W

        xobjects = xobjects.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))).where(F.col("_n") <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                try:
                    w, h, n, out, error = *pixels(r), None
                except Exception as e:  # noqa: BLE001 - a hostile image is its own row
                    w, h, n, out, error = 0, 0, 0, None, str(e) or type(e).__name__
                row = [[r["doc_id"]], [r["page"]], [r["ord"]], [r["name"]], [w], [h], [n], [out], [error]]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [c.split(" ")[0] for c in RASTER.split(", ")])

    ship(xobjects.sparkSession)
    return xobjects.select(*_COLUMNS).mapInArrow(run, RASTER)


def color_images(binary: DataFrame, password: str | None = None) -> DataFrame:
    """Pixels of all image XObjects of (doc_id, content), in their documents' colour spaces: palettes, inks
    with tint functions, profiles and Lab need the document, so this is a facet of the kernel's own pass."""
    from vellum.sources.pdf import facts, split

    return split(facts(binary, password, ("raster",)), "raster")


def sums(images: DataFrame, period: int) -> DataFrame:
    """(doc_id, width, height, components, total, weighted): all samples added up, plain and with weights that go from
    1 to ``period`` again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            found = [np.frombuffer(s or b"", np.uint8).astype(np.int64) for s in b.column(4).to_pylist()]
            weighted = [int((v * (np.arange(len(v)) % period + 1)).sum()) for v in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([int(v.sum()) for v in found], pa.int64()), pa.array(weighted, pa.int64())], ["doc_id", "width", "height", "components", "total", "weighted"])

    ship(images.sparkSession)
    return images.select("doc_id", "width", "height", "components", "samples").mapInArrow(run, "doc_id string, width int, height int, components int, total long, weighted long")


def bmp(width: int, height: int, components: int, samples: bytes) -> bytes:
    """A 24-bit bitmap file, as engines read it."""
    import numpy as np

    a = np.frombuffer(samples, np.uint8).reshape(height, width, components)
    a = np.repeat(a, 3, 2) if components == 1 else a[:, :, 2::-1]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = a[::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def recognize(rasters: DataFrame, engine: Callable[[int, int, int, bytes], list[tuple[str, float, float, float, float, float]]], least: float = 0.0) -> DataFrame:
    """Lines that ``engine`` reads on each image: (text, x, y, width, height, confidence). An engine that fails
    on an image gives no lines for it and does no harm to others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in LINES.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.float64()] * 5]
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    found = engine(r["width"], r["height"], r["components"], r["samples"])
                except Exception:  # noqa: BLE001 - see above
                    continue
                rows = [(r["doc_id"], r["page"], r["ord"], *x) for x in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    ship(rasters.sparkSession)
    return rasters.where("error IS NULL").select("doc_id", "page", "ord", "width", "height", "components", "samples").mapInArrow(run, LINES).where(F.col("confidence") >= least)
