"""JPEG 2000 against a stream put together by hand and against an encoder written for these tests."""

import numpy as np
import pytest

from tests.jpx_encoder import BYPASS, CAUSAL, RESET, SEGMARK, TERMINATE, encode
from vellum.kernel import jpx
from vellum.kernel.objects import PdfError


def pixels(data):
    w, h, n, samples = jpx.decode(data)
    return np.frombuffer(samples, np.uint8).reshape(h, w, n)


def picture(h, w, n, seed=0):
    """A smooth picture with edges and some noise."""
    r = np.random.RandomState(seed)
    y, x = np.mgrid[:h, :w]
    a = np.stack([128 + 80 * np.sin(x / (5 + k)) * np.cos(y / 7) + 30 * (x > w // 2) + r.randint(-8, 9, (h, w)) for k in range(n)], 2)
    return np.clip(a, 0, 255).astype(np.uint8)


def test_a_stream_by_hand():
    """Nine samples in a column, one level: five low and four high coefficients."""
    head = "FF4FFF5100290000000000010000000900000000000000000000000100000009000000000000000000010701 01FF5C00074040484850FF52000C00000001000103030001FF90000A00000000001E0001FF93"
    data = bytes.fromhex((head + "C7D40C018F0DC8757FC07C21800FB176FFD9").replace(" ", ""))
    assert pixels(data).ravel().tolist() == [101, 103, 104, 105, 96, 97, 96, 102, 109]


@pytest.mark.parametrize("flags", [0, CAUSAL, RESET, TERMINATE, SEGMARK, BYPASS, BYPASS | TERMINATE, CAUSAL | RESET | TERMINATE | SEGMARK])
def test_coding_styles(flags):
    a = picture(33, 41, 1, flags)
    assert (pixels(encode(a, levels=2, flags=flags)) == a).all()


@pytest.mark.parametrize("order", range(5))
@pytest.mark.parametrize("layers", [1, 3])
def test_progressions_and_layers(order, layers):
    a = picture(50, 37, 3, order)
    assert (pixels(encode(a, levels=3, mct=True, order=order, layers=layers, flags=TERMINATE, precinct=4, sop=layers == 3)) == a).all()


@pytest.mark.parametrize("origin,tile", [((0, 0), (20, 16)), ((5, 3), None), ((7, 9), (16, 24))])
@pytest.mark.parametrize("levels", [0, 1, 4])
def test_tiles_and_origins(origin, tile, levels):
    a = picture(40, 45, 1, levels)
    assert (pixels(encode(a, levels=levels, origin=origin, tile=tile)) == a).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (2, 3), (5, 64)])
def test_small_pictures(shape):
    a = picture(*shape, 1)
    assert (pixels(encode(a, levels=3)) == a).all()


@pytest.mark.parametrize("n", [1, 3])
def test_irreversible(n):
    a = picture(48, 40, n, n)
    got = pixels(encode(a, levels=3, reversible=False, mct=n == 3)).astype(int)
    assert np.abs(got - a).max() <= 1
    coarse = pixels(encode(a, levels=3, reversible=False, mct=n == 3, step=4)).astype(int)
    assert 0 < np.abs(coarse - a).mean() < 6


def test_boxes_palettes_and_components():
    a = picture(12, 10, 1)
    box = lambda kind, data: (8 + len(data)).to_bytes(4, "big") + kind + data
    stream = encode(a)
    head = box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 \0\0\0\0jp2 ")
    assert (pixels(head + box(b"jp2h", box(b"ihdr", bytes(14))) + box(b"jp2c", stream)) == a).all()
    colours = np.random.RandomState(1).randint(0, 256, (256, 3)).astype(np.uint8)
    palette = box(b"pclr", b"\1\0\3\7\7\7" + colours.tobytes()) + box(b"cmap", b"\0\0\1\0\0\0\1\1\0\0\1\2")
    assert (pixels(head + box(b"jp2h", palette) + box(b"jp2c", stream)) == colours[a[..., 0]]).all()
    four = picture(12, 10, 4)
    assert (pixels(encode(four)) == four).all()
    assert jpx.plain(4, four.tobytes()) == (3, four[..., :3].tobytes()) and jpx.plain(2, bytes([1, 2, 3, 4])) == (1, bytes([1, 3]))


def test_damage():
    """Cut and changed streams give a picture or an error, and never anything else; an earlier cut is a coarser one."""
    a = picture(32, 32, 1, 3)
    data = encode(a, levels=3, layers=4, flags=TERMINATE)
    worse = [np.abs(pixels(data[:n]).astype(int) - a).mean() for n in (len(data), len(data) * 2 // 3, len(data) // 3)]
    assert worse[0] == 0 < worse[1] < worse[2]
    r = np.random.RandomState(1)
    for _ in range(80):
        d = bytearray(data)
        for _ in range(r.randint(1, 4)):
            d[r.randint(50, len(d))] = r.randint(256)
        try:
            jpx.decode(bytes(d))
        except PdfError:
            pass
    for bad in (b"", b"\xff\x4f", data[:40], b"\0\0\0\x0cjP  \r\n\x87\n"):
        with pytest.raises(PdfError):
            jpx.decode(bad)


def test_pictures_of_documents(spark):
    """An image of a file comes out as its pixels, in its document's colour space or by its number of components."""
    from tests.test_images import scan
    from vellum.operators import rasters

    rgb, gray = picture(16, 20, 3), picture(16, 20, 1)
    made = [(name, bytearray(scan(encode(a, mct=a.shape[2] == 3), b"/Filter /JPXDecode /Width 20 /Height 16" + more))) for name, a, more in (("a", rgb, b""), ("b", gray, b" /ColorSpace /DeviceGray"), ("c", rgb, b" /ColorSpace /DeviceRGB"))]
    got = {r.doc_id: r for r in rasters.color_images(spark.createDataFrame(made, "doc_id string, content binary")).collect()}
    for name, a in (("a", rgb), ("b", gray), ("c", rgb)):
        assert got[name].error is None and (got[name].width, got[name].height, got[name].components) == (20, 16, a.shape[2]) and bytes(got[name].samples) == a.tobytes()
