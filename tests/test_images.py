"""Codecs, colour, functions, and images of documents to pixels."""

import math

import numpy as np
import pytest

from vellum.kernel import ccitt, color, functions, jpeg
from vellum.kernel.objects import Name
from vellum.operators import ocr, rasters
from vellum.operators.record import Facts
from vellum.sources.synthesize import document, stream, text_pdf
from tests.encoders import baseline_jpeg, group4, progressive_jpeg


class Nothing:
    def resolve(self, x):
        return x

    def decoded(self, s):
        return s.raw


def picture(h, w, n, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    r = np.random.RandomState(seed)
    return np.clip(np.stack([128 + 90 * np.sin((x * (i + 1) + y) / 11 + r.rand()) for i in range(n)], 2), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("h,w,n", [(8, 8, 1), (16, 24, 3), (13, 9, 3), (17, 33, 1)])
@pytest.mark.parametrize("encode", [baseline_jpeg, progressive_jpeg])
def test_jpeg(h, w, n, encode):
    a = picture(h, w, n)
    got = jpeg.decode(encode(a))
    assert got[:3] == (w, h, n)
    b = np.frombuffer(got[3], np.uint8).reshape(h, w, n)
    assert np.abs(a.astype(int) - b).max() <= 6
    m = jpeg.metadata(encode(a))
    assert (m["width"], m["height"], m["components"], m["progressive"]) == (w, h, n, encode is progressive_jpeg)


def test_jpeg_damage():
    data = bytearray(baseline_jpeg(picture(32, 32, 3)))
    r = np.random.RandomState(1)
    for _ in range(60):
        d = bytearray(data)
        for _ in range(5):
            d[r.randint(len(d))] = r.randint(256)
        try:
            jpeg.decode(bytes(d[: r.randint(20, len(d))]))
        except (jpeg.PdfError, ValueError, IndexError):
            pass


def test_group4():
    r = np.random.RandomState(0)
    for t in range(40):
        w, h = r.randint(1, 200), r.randint(1, 12)
        a = (r.rand(h, w) < r.choice([0.02, 0.3, 0.9])).astype(int)
        columns, rows, packed = ccitt.decode(group4(a), -1, w, 0, True)
        got = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(rows, -1), axis=1)[:, :w]
        assert columns == w and rows == h and (got == a).all()


def test_unpack_and_gray():
    assert color.unpack(b"\xa0\x50", 4, 2, 1, 1).reshape(2, 4).tolist() == [[1, 0, 1, 0], [0, 1, 0, 1]]
    assert color.unpack(b"\x1b", 4, 1, 1, 2).ravel().tolist() == [0, 1, 2, 3]
    assert color.unpack(b"\x12\x34", 1, 1, 1, 16).ravel().tolist() == [0x1234]
    assert color.to_rgb(b"\x80\xff", 2, 1, 1, 8, color.Space("DeviceGray", 1)) == (1, b"\x80\xff")
    assert color.to_rgb(b"\x80", 1, 1, 1, 8, color.Space("DeviceGray", 1), [1, 0]) == (1, b"\x7f")


def test_spaces():
    f = Nothing()
    indexed = color.resolve(f, [Name("Indexed"), Name("DeviceRGB"), 1, b"\xff\x00\x00\x00\xff\x00"])
    assert color.to_rgb(b"\x40", 2, 1, 1, 1, indexed) == (3, b"\x00\xff\x00"[:0] + b"\xff\x00\x00\x00\xff\x00")
    tint = color.resolve(f, [Name("Separation"), Name("Spot"), Name("DeviceRGB"), {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [1, 0, 0], "N": 1}])
    assert color.to_rgb(b"\x00\xff", 2, 1, 1, 8, tint) == (3, b"\xff\xff\xff\xff\x00\x00")
    lab = color.resolve(f, [Name("Lab"), {"WhitePoint": [0.9505, 1, 1.089]}])
    assert lab.rgb(np.array([[100.0, 0, 0], [0, 0, 0]])).tolist() == [[255] * 3, [0] * 3]
    assert color.resolve(f, Name("DeviceCMYK")).rgb(np.zeros((1, 4))).tolist() == [[255, 255, 255]]


def test_functions():
    stitched = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [{"FunctionType": 2, "N": 1}, {"FunctionType": 2, "N": 2}]}
    y = functions.parse(Nothing(), stitched)(np.array([[0.25], [0.5], [1.0]]))
    assert np.allclose(y.ravel(), [0.5, 1.0, 0.0])
    c = lambda code, *x, k=1: functions.Calculator([-100, 100] * len(x), [-1000, 1000] * k, code)(np.array([x], float)).ravel().tolist()
    assert c(b"{ dup mul exch dup mul add sqrt }", 3, 4) == [5.0]
    assert c(b"{ 2 gt { 1 } { 0 } ifelse }", 3) == [1.0] and c(b"{ 0 div }", 3) == [0.0]
    assert c(b"{ 1 2 3 3 1 roll }", 9, k=4) == [9, 3, 1, 2] and c(b"{ 30 sin }", 0)[0] == pytest.approx(math.sin(math.radians(30)))
    s = functions.Sampled([0, 1, 0, 1], [0, 1], [2, 2], 8, [0, 1, 0, 1], [0, 1], bytes([0, 255, 255, 0]))
    assert np.allclose(s(np.array([[0.5, 0.5], [1, 0], [0, 0.5]])).ravel(), [0.5, 1, 0.5])


def scan(encoded: bytes, more: bytes) -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 612 792] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /XObject << /I 4 0 R >> >> >>", 4: stream(b"/Subtype /Image " + more, encoded), 5: stream(b"", b"q 612 0 0 792 0 0 cm /I Do Q")}
    return document(objects)


def test_documents_to_pixels_and_lines(spark):
    a = picture(16, 16, 3)
    made = [("jpeg", scan(baseline_jpeg(a), b"/Width 16 /Height 16 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode")), ("fax", scan(group4(np.eye(24, dtype=int)), b"/Width 24 /Height 24 /ImageMask true /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns 24 >>")), ("raw", text_pdf("x", image=True)), ("bad", scan(b"nothing", b"/Width 1 /Height 1 /Filter /JPXDecode"))]
    f = Facts(spark.createDataFrame([(k, bytearray(v)) for k, v in made], "doc_id string, content binary"), facets=("document", "page", "run", "image", "field", "xobject"))
    got = {r.doc_id: r for r in rasters.decode(f.xobjects).collect()}
    assert (got["jpeg"].width, got["jpeg"].components) == (16, 3) and np.abs(np.frombuffer(got["jpeg"].samples, np.uint8).astype(int) - a.reshape(-1)).max() <= 6
    assert (got["fax"].width, got["fax"].height, got["raw"].samples[:4]) == (24, 24, bytes(range(4))) and got["bad"].error and got["bad"].samples is None

    def engine(width, height, components, samples):
        if components == 3:
            raise RuntimeError("no colour")
        return [(f"{width}x{height}", 1.0, 2.0, 3.0, 4.0, 0.9), ("noise", 0.0, 0.0, 0.0, 0.0, 0.1)]

    lines = rasters.recognize(rasters.decode(f.xobjects), engine, 0.5).collect()
    assert sorted((r.doc_id, r.text) for r in lines) == [("fax", "24x24"), ("raw", "8x8")]
    assert f.classified().where("page_class = 'ScannedImageOnly'").count() == 4
    assert rasters.bmp(2, 1, 1, b"\x00\xff")[:2] == b"BM" and len(rasters.bmp(2, 1, 1, b"\x00\xff")) == 62
    assert rasters.decode(f.xobjects, most=0).count() == 0 and ocr.BANDS


def test_colour_images(spark):
    palette = scan(bytes([0b01000000]), b"/Width 2 /Height 1 /BitsPerComponent 1 /ColorSpace [/Indexed /DeviceRGB 1 <FF000000FF00>]")
    ink = scan(bytes([0, 255]), b"/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace [/Separation /Spot /DeviceCMYK << /FunctionType 2 /Domain [0 1] /C0 [0 0 0 0] /C1 [0 0 0 1] /N 1 >>]")
    mask = scan(bytes([0b10000000]), b"/Width 2 /Height 1 /ImageMask true")
    pattern = scan(b"x", b"/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /Pattern")
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in (("palette", palette), ("ink", ink), ("mask", mask), ("pattern", pattern), ("none", b"no"))], "doc_id string, content binary")
    got = {r.doc_id: r for r in rasters.color_images(df).collect()}
    assert set(got) == {"palette", "ink", "mask", "pattern"} and bytes(got["palette"].samples) == b"\xff\x00\x00\x00\xff\x00"
    assert bytes(got["ink"].samples)[:3] == b"\xff\xff\xff" and max(got["ink"].samples[3:]) < 60 and bytes(got["mask"].samples) == b"\xff\x00" and got["pattern"].error


def test_sums_of_samples(spark):
    """Samples are added up a whole image at once, not by an expression for each byte."""
    from vellum.operators import rasters
    from vellum.plans import pdf_queries

    made = [("a", 2, 1, 1, bytearray(b"\xff\x01"), None), ("b", 1, 1, 3, bytearray(range(100, 103)), None), ("c", 0, 0, 0, bytearray(), None), ("d", 10, 20, 1, bytearray(200 * b"\x02"), None)]
    df = spark.createDataFrame(made, "doc_id string, width int, height int, components int, samples binary, error string")
    got = {r.doc_id: (r.total, r.weighted) for r in rasters.sums(df, 97).collect()}
    assert got == {"a": (256, 257), "b": (303, 100 + 202 + 306), "c": (0, 0), "d": (400, sum(2 * (i % 97 + 1) for i in range(200)))}
    assert "conv(" not in pdf_queries.pdf_images(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
