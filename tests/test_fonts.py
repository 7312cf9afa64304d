"""Font programs put together here, their outlines and coverage."""

import struct

import numpy as np
import pytest

from vellum.kernel import outlines, raster
from vellum.kernel.objects import PdfError


def sfnt(parts):
    out, at, body = struct.pack(">4sHHHH", b"\0\1\0\0", len(parts), 0, 0, 0), 12 + 16 * len(parts), b""
    for tag, data in parts.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at + len(body), len(data))
        body += data
    return out + body


def truetype():
    square = struct.pack(">hhhhh", 1, 100, 0, 500, 400) + struct.pack(">HH", 3, 0) + bytes([1] * 4) + struct.pack(">hhhh", 100, 400, 0, -400) + struct.pack(">hhhh", 0, 0, 400, 0)
    disc = struct.pack(">hhhhh", 1, 0, 0, 400, 400) + struct.pack(">HH", 3, 0) + bytes([0] * 4) + struct.pack(">hhhh", 0, 400, 0, -400) + struct.pack(">hhhh", 0, 0, 400, 0)
    both = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHhh", 0x23, 1, 1000, 0) + struct.pack(">HHbbh", 0xA, 2, 5, 6, 8192)
    glyphs = [b"", square, disc, both]
    glyphs = [g + b"\0" * (len(g) % 2) for g in glyphs]
    loca = np.cumsum([0] + [len(g) for g in glyphs])
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 1000)
    hhea = bytearray(36)
    struct.pack_into(">H", hhea, 34, 2)
    cmap4 = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 67, 0xFFFF) + b"\0\0" + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">HH", (1 - 65) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    return sfnt({"head": bytes(head), "maxp": struct.pack(">IH", 0x10000, 4), "loca": b"".join(struct.pack(">H", v // 2) for v in loca), "glyf": b"".join(glyphs), "hhea": bytes(hhea), "hmtx": struct.pack(">HhHh", 500, 0, 600, 0), "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + cmap4})


def test_truetype():
    p = outlines.Program(truetype())
    assert p.kind == "TrueType" and p.units == 1000
    a = p.by_code(65)
    assert a.advance == 600 and [s[0] for s in a.contours[0]] == [(100, 0), (500, 0), (500, 400), (100, 400)]
    disc = p.by_code(66).contours[0]
    assert all(len(s) == 3 for s in disc) and len(disc) == 4
    c = p.by_code(67).contours
    assert c[0][0][0] == (1100, 0) and max(x for s in c[1] for x, _ in s) == 205
    assert p.glyph(99).contours == [] and p.by_code(7).contours == []


def cff():
    num = lambda v: bytes([28]) + struct.pack(">h", v)
    real = lambda v: bytes([29]) + struct.pack(">i", v)
    idx = lambda items: struct.pack(">H", len(items)) + (bytes([2]) + b"".join(struct.pack(">H", v) for v in np.cumsum([1] + [len(i) for i in items]).tolist()) + b"".join(items) if items else b"")
    square = num(50) + num(100) + num(0) + bytes([21]) + num(400) + num(400) + num(-400) + bytes([6, 14])
    curve = num(0) + num(0) + bytes([21]) + num(0 - 107) + bytes([10]) + bytes([14])
    subr = b"".join(map(num, (0, 100, 100, 100, 100, 0))) + bytes([8, 11])
    chars = idx([bytes([14]), square, curve])
    private = num(500) + bytes([20]) + num(600) + bytes([21]) + num(12) + bytes([19])
    names = idx([b"F"])
    strings, globals_ = idx([]), idx([])
    size = 5 * 4 + 4
    head = b"\1\0\4\2" + names
    after = len(head) + 2 + 1 + 4 + size + len(strings) + len(globals_)
    charset = after
    at_chars = charset + 1 + 4
    at_private = at_chars + len(chars)
    top = real(charset) + bytes([15]) + real(at_chars) + bytes([17]) + real(len(private)) + real(at_private) + bytes([18])
    top += bytes([0]) * 0
    tops = struct.pack(">H", 1) + bytes([2]) + struct.pack(">HH", 1, 1 + len(top)) + top
    pad = after - (len(head) + len(tops) + len(strings) + len(globals_))
    body = head + tops + strings + globals_
    assert pad >= 0
    return body + b"\0" * pad + bytes([0]) + struct.pack(">HH", 34, 35) + chars + private + idx([subr])


def test_cff():
    p = outlines.Program(cff())
    assert p.kind == "CFF"
    a, b = p.by_name("A"), p.by_name("B")
    assert a.advance == 650 and [s[0] for s in a.contours[0]] == [(100, 0), (500, 0), (500, 400), (100, 400)]
    assert b.advance == 500 and b.contours[0][0] == ((0, 0), (0, 100), (100, 200), (200, 200)) and len(b.contours[0]) == 2
    assert p.by_code(65).advance == 650


def encrypt(data, key):
    out = bytearray()
    for c in data:
        e = c ^ (key >> 8)
        out.append(e)
        key = ((e + key) * 52_845 + 22_719) & 0xFFFF
    return bytes(out)


def type1():
    n = lambda v: bytes([v + 139]) if -107 <= v <= 107 else bytes([255]) + struct.pack(">i", v)
    char = lambda b: encrypt(b"\0\0\0\0" + b, 4330)
    square = n(10) + n(600) + bytes([13]) + n(90) + bytes([22]) + n(400) + bytes([6]) + n(400) + bytes([7]) + n(-400) + bytes([6, 9, 14])
    accented = n(10) + n(600) + bytes([13]) + n(10) + n(50) + n(70) + n(65) + n(66) + bytes([12, 6])
    parts = {"A": square, "B": n(10) + n(500) + bytes([13]) + n(0) + bytes([10, 14]), "C": accented}
    sub = n(0) + bytes([22]) + n(100) + n(50) + bytes([5]) + n(-100) + bytes([6, 9, 11])
    private = b"dup /Private 8 dict dup begin /lenIV 4 def /Subrs 1 array\ndup 0 %d RD " % (len(sub) + 4) + char(sub) + b" NP\n/CharStrings 3 dict dup begin\n"
    private += b"".join(b"/%s %d RD " % (k.encode(), len(v) + 4) + char(v) + b" ND\n" for k, v in parts.items()) + b"end"
    return b"%!PS-AdobeFont-1.0: F\n/FontMatrix [0.001 0 0 0.001 0 0] def\ncurrentfile eexec\n" + encrypt(b"xyzw" + private, 55_665)


def test_type1():
    p = outlines.Program(type1())
    a = p.by_name("A")
    assert p.kind == "Type1" and a.advance == 600 and [s[0] for s in a.contours[0]] == [(100, 0), (500, 0), (500, 400), (100, 400)]
    assert len(p.by_name("B").contours[0]) == 3
    c = p.by_name("C").contours
    assert len(c) == 2 and c[1][0][0] == (60, 70)


def test_coverage():
    p = outlines.Program(truetype())
    b = raster.render(p, 1, 100)
    assert (b.width, b.height, b.left, b.top) == (40, 40, 10, 40) and set(b.coverage) == {255}
    b = raster.render(p, 1, 12.5)
    assert sum(b.coverage) / 255 == pytest.approx(25, abs=0.3)
    disc = raster.render(p, 2, 100)
    area = sum(disc.coverage) / 255
    assert area == pytest.approx(40 * 40 * 5 / 6, rel=0.02) and disc.coverage[0] < 255  # four parabolic corners
    ring = p.glyph(1).contours + [[tuple((x / 2 + 150, y / 2 + 100) for x, y in reversed(s)) for s in reversed(p.glyph(1).contours[0])]]
    assert sum(raster.fill(raster.flatten(ring, 0.1)).coverage) / 255 == pytest.approx(40 * 40 - 20 * 20, rel=0.01)
    assert raster.fill([]).width == 0


def test_broken_programs():
    r = np.random.RandomState(0)
    for make in (truetype(), cff(), type1()):
        for _ in range(150):
            d = bytearray(make)
            for _ in range(r.randint(1, 8)):
                d[r.randint(len(d))] = r.randint(256)
            try:
                p = outlines.Program(bytes(d[: r.randint(4, len(d))]) if r.rand() < 0.3 else bytes(d))
                for g in (0, 1, 2, 3, "A", "C"):
                    if isinstance(g, str) == (p.kind == "Type1"):
                        p.glyph(g)
            except (PdfError, IndexError, KeyError, ValueError, struct.error, ZeroDivisionError, OverflowError):
                pass
    with pytest.raises(PdfError):
        outlines.Program(b"none of them")
