"""JBIG2 against the standard's arithmetic vector and against an encoder written here."""

import numpy as np
import pytest

from tests.encoders import group4
from vellum.kernel import jbig2
from vellum.kernel.objects import PdfError


def test_arithmetic_vector():
    data = bytes.fromhex("84C73B FCE1A1 430402 2000 00410DBB 86F4317F FF88FF37 471ADB6A DFFFAC".replace(" ", ""))
    want = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
    mq, c = jbig2.Mq(data), [0]
    bits = [mq.bit(c, 0) for _ in range(256)]
    assert np.packbits(bits).tobytes() == want


class Encoder:
    def __init__(self):
        self.a, self.c, self.count, self.out = 0x8000, 0, 12, bytearray(b"\0")
        self.tables = {}

    def _byte(self):
        if self.out[-1] == 0xFF:
            stuffed = True
        elif self.c < 0x8000000:
            stuffed = False
        else:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
                stuffed = True
            else:
                stuffed = False
        if stuffed:
            self.out.append(self.c >> 20 & 0xFF)
            self.c, self.count = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c, self.count = self.c & 0x7FFFF, 8

    def bit(self, contexts, i, d):
        s = contexts[i]
        qe, more, less, switch = jbig2._QE[s >> 1]
        self.a -= qe
        if d == s & 1:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            contexts[i] = more << 1 | s & 1
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            contexts[i] = less << 1 | (s & 1 ^ switch)
        while True:
            self.a <<= 1
            self.c <<= 1
            self.count -= 1
            if not self.count:
                self._byte()
            if self.a & 0x8000:
                return

    def end(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.count
            self._byte()
        return bytes(self.out[1:]) + b"\xff\xac"

    def number(self, name, v):
        c, before = self.tables.setdefault(name, [0] * 512), 1

        def bit(d):
            nonlocal before
            self.bit(c, before, d)
            before = before << 1 | d if before < 256 else ((before << 1 | d) & 511) | 256

        bit(int(v is None or v < 0))
        m = abs(v or 0)
        for k, (bits, base, top) in enumerate(((2, 0, 4), (4, 4, 20), (6, 20, 84), (8, 84, 340), (12, 340, 4436), (32, 4436, 1 << 40))):
            if m < top:
                for _ in range(k):
                    bit(1)
                if k < 5:
                    bit(0)
                for j in range(bits - 1, -1, -1):
                    bit(m - base >> j & 1)
                return

    def symbol(self, bits, v):
        c, before = self.tables.setdefault("IAID", [0] * (2 << bits)), 1
        for j in range(bits - 1, -1, -1):
            self.bit(c, before, v >> j & 1)
            before = before << 1 | v >> j & 1

    def region(self, contexts, image, template, adaptive, typical=False):
        pixels, movable, repeat = jbig2._TEMPLATES[template]
        place = dict(zip(movable, adaptive))
        h, w = image.shape
        at = lambda x, y: int(image[y, x]) if 0 <= x < w and 0 <= y < h else 0
        was = 0
        for y in range(h):
            if typical:
                same = int((image[y] == (image[y - 1] if y else 0)).all())
                self.bit(contexts, repeat, same ^ was)
                was = same
                if same:
                    continue
            for x in range(w):
                c = 0
                for p in pixels:
                    dx, dy = place.get(p, p)
                    c = c << 1 | at(x + dx, y + dy)
                self.bit(contexts, c, at(x, y))


def segment(number, kind, data, refers=()):
    return number.to_bytes(4, "big") + bytes([kind, len(refers) << 5, *refers, 1]) + len(data).to_bytes(4, "big") + data


def u32(*v):
    return b"".join(x.to_bytes(4, "big") for x in v)


def page(w, h):
    return segment(1, 48, u32(w, h, 0, 0) + b"\0\0\0")


def pairs(adaptive):
    return np.array(adaptive, np.int8).tobytes()


def bits(result):
    w, h, packed = result
    return np.unpackbits(np.frombuffer(packed, np.uint8).reshape(h, -1), axis=1)[:, :w]


@pytest.mark.parametrize("template", [0, 1, 2, 3])
@pytest.mark.parametrize("typical", [False, True])
def test_generic_regions(template, typical):
    r = np.random.RandomState(template)
    image = (r.rand(23, 37) < 0.3).astype(np.uint8)
    image[5:9] = image[5]
    adaptive = jbig2._TEMPLATES[template][1]
    for a in (adaptive, [(-7, -3)] + adaptive[1:]):
        if typical and a is not adaptive:
            continue
        e = Encoder()
        e.region([0] * 65_536, image, template, a, typical)
        data = page(40, 30) + segment(2, 38, u32(37, 23, 2, 3) + bytes([0, template << 1 | typical << 3]) + pairs(a) + e.end())
        got = bits(jbig2.decode(data))
        assert (got[3:26, 2:39] == image).all() and got.sum() == image.sum()


def test_mmr_region():
    image = np.eye(20, dtype=int)
    data = page(20, 20) + segment(2, 38, u32(20, 20, 0, 0) + b"\0\1" + group4(image))
    assert (bits(jbig2.decode(data)) == image).all()


def symbols():
    r = np.random.RandomState(5)
    return [(r.rand(6, 4) < 0.5).astype(np.uint8), (r.rand(6, 5) < 0.5).astype(np.uint8), (r.rand(9, 3) < 0.5).astype(np.uint8)]


def symbol_dictionary():
    e, contexts, adaptive = Encoder(), [0] * 65_536, jbig2._TEMPLATES[0][1]
    s = symbols()
    e.number("IADH", 6)
    for step, b in ((4, s[0]), (1, s[1])):
        e.number("IADW", step)
        e.region(contexts, b, 0, adaptive)
    e.number("IADW", None)
    e.number("IADH", 3)
    e.number("IADW", 3)
    e.region(contexts, s[2], 0, adaptive)
    e.number("IADW", None)
    e.number("IAEX", 0)
    e.number("IAEX", 3)
    return b"\0\0" + pairs(adaptive) + u32(3, 3) + e.end()


@pytest.mark.parametrize("corner", [0, 1, 2, 3])
@pytest.mark.parametrize("across", [0, 1])
def test_symbols_and_text(corner, across):
    s, e = symbols(), Encoder()
    e.number("IADT", 0)
    want = np.zeros((60, 60), np.uint8)
    place = []
    for strip, (dt, df, items) in enumerate([(20, 12, [(0, None), (2, 3), (1, 1)]), (18, 3, [(1, None), (1, 2)])]):
        e.number("IADT", dt)
        e.number("IAFS", df)
        t = sum((20, 18)[: strip + 1])
        cur = sum((12, 3)[: strip + 1])
        for i, step in items:
            if step is not None:
                e.number("IADS", step)
                cur += step
            e.symbol(2, i)
            h, w = s[i].shape
            far = h - 1 if across else w - 1
            before = corner in ((0, 2) if across else (2, 3))
            cur += far if before else 0
            x, y = (t, cur) if across else (cur, t)
            place.append((s[i], x - (w - 1 if corner in (2, 3) else 0), y - (h - 1 if corner in (0, 2) else 0)))
            cur += 0 if before else far
        e.number("IADS", None)
    for b, x, y in place:
        want[y : y + b.shape[0], x : x + b.shape[1]] |= b
    text = u32(60, 60, 0, 0) + b"\0" + (corner << 4 | across << 6).to_bytes(2, "big") + u32(5) + e.end()
    data = page(60, 60) + segment(3, 6, text, [0])
    globals_ = segment(0, 0, symbol_dictionary())
    assert (bits(jbig2.decode(data, globals_)) == want).all()
    assert jbig2.inspect(data, globals_) == {"types": [0, 48, 6], "huffman": False, "refinement": False, "halftone": False, "supported": True}


def test_damage():
    data = page(60, 60) + segment(3, 38, u32(10, 10, 0, 0) + b"\0\0" + pairs(jbig2._TEMPLATES[0][1]) + b"abcdefgh") + segment(4, 0, symbol_dictionary())
    r = np.random.RandomState(0)
    for _ in range(60):
        d = bytearray(data)
        for _ in range(3):
            d[r.randint(len(d))] = r.randint(256)
        try:
            d[11:19] = data[11:19]  # the page keeps its size
            jbig2.decode(bytes(d))
        except PdfError:
            pass
    with pytest.raises(PdfError):
        jbig2.decode(b"nothing")
    assert not jbig2.inspect(b"")["supported"]


def refine(e, contexts, image, base, dx, dy, template, adaptive, typical=False):
    """Encodes ``image`` as a refinement of ``base``, whose corner lies at (dx, dy) in it."""
    at = lambda a, x, y: int(a[y, x]) if 0 <= x < a.shape[1] and 0 <= y < a.shape[0] else 0
    own, other, repeat = jbig2._REFINE[template]
    if not template:
        own, other = [*own, adaptive[0]], [*other, adaptive[1]]
    was = 0
    for y in range(image.shape[0]):
        flat = []
        for x in range(image.shape[1]):
            around = {at(base, x - dx + u, y - dy + v) for u in (-1, 0, 1) for v in (-1, 0, 1)}
            flat.append(around.pop() if len(around) == 1 else None)
        same = 0
        if typical:
            same = int(all(f is None or f == image[y, x] for x, f in enumerate(flat)))
            e.bit(contexts, repeat, same ^ was)
            was = same
        for x in range(image.shape[1]):
            if same and flat[x] is not None:
                continue
            c = 0
            for u, v in own:
                c = c << 1 | at(image, x + u, y + v)
            for u, v in other:
                c = c << 1 | at(base, x - dx + u, y - dy + v)
            e.bit(contexts, c, int(image[y, x]))


@pytest.mark.parametrize("template", [0, 1])
@pytest.mark.parametrize("typical", [False, True])
def test_refinement_regions(template, typical):
    r = np.random.RandomState(template)
    base = np.kron(r.rand(6, 8) < 0.4, np.ones((4, 4))).astype(np.uint8)
    image = base ^ (r.rand(*base.shape) < 0.03)
    adaptive = [] if template else [(-1, -1), (-2, 3)]
    e = Encoder()
    e.region([0] * 65_536, base, 0, jbig2._TEMPLATES[0][1])
    first = u32(32, 24, 3, 2) + b"\0\0" + pairs(jbig2._TEMPLATES[0][1]) + e.end()
    e = Encoder()
    refine(e, [0] * 8192, image, base, 0, 0, template, adaptive, typical)
    second = u32(32, 24, 3, 2) + bytes([0, template | typical << 1]) + pairs(adaptive) + e.end()
    for kind, refers in ((36, [2]), (38, [])):  # of a region kept for it, and of what is on the page
        data = page(40, 30) + segment(2, kind, first) + segment(3, 42, second, refers)
        got = bits(jbig2.decode(data))
        assert (got[2:26, 3:35] == image).all() and got.sum() == image.sum() and jbig2.decode_page(data)[3] == []
        assert jbig2.inspect(data)["supported"] and jbig2.inspect(data)["refinement"]


@pytest.mark.parametrize("template", [0, 1])
def test_refined_symbols_of_a_text(template):
    s, e = symbols(), Encoder()
    bigger = np.zeros((8, 6), np.uint8)
    bigger[1:7, 1:5] = s[0]
    bigger[0, 0] = bigger[7, 5] = 1
    adaptive = [] if template else [(-1, -1), (-1, -1)]
    contexts = [0] * 8192
    e.number("IADT", 0)
    e.number("IADT", 10)
    e.number("IAFS", 5)
    e.symbol(2, 0)
    e.number("IARI", 1)
    for name, v in (("IARDW", 2), ("IARDH", 2), ("IARDX", 0), ("IARDY", 0)):
        e.number(name, v)
    refine(e, contexts, bigger, s[0], 1, 1, template, adaptive)
    e.number("IADS", 4)
    e.symbol(2, 2)
    e.number("IARI", 0)
    e.number("IADS", None)
    text = u32(40, 40, 0, 0) + b"\0" + (2 | 1 << 4 | template << 15).to_bytes(2, "big") + pairs(adaptive) + u32(2) + e.end()
    want = np.zeros((40, 40), np.uint8)
    want[10:18, 5:11] = bigger
    want[10:19, 14:17] |= s[2]
    assert (bits(jbig2.decode(page(40, 40) + segment(3, 6, text, [0]), segment(0, 0, symbol_dictionary()))) == want).all()


def test_pages_of_unknown_height():
    image = np.eye(20, dtype=int)
    region = lambda n, y: segment(n, 38, u32(20, 20, 0, y) + b"\0\1" + group4(image))
    head = segment(1, 48, u32(20, 0xFFFFFFFF, 0, 0) + b"\0\x80\x14")
    assert bits(jbig2.decode(head + region(2, 0) + segment(3, 50, u32(19)) + region(4, 20) + segment(5, 50, u32(44)))).shape == (45, 20)
    assert bits(jbig2.decode(head + region(2, 0))).shape == (20, 20)


def test_what_is_left_out_is_an_error(spark):
    """Pixels of an image with a halftone, or a broken region, are an error row and no blank."""
    from vellum.operators import rasters

    image = np.eye(20, dtype=int)
    good = page(20, 20) + segment(2, 38, u32(20, 20, 0, 0) + b"\0\1" + group4(image))
    fact = dict.fromkeys(rasters._COLUMNS) | {"codec": "JBIG2Decode", "data": good, "globals": None, "decode": None}
    assert rasters.pixels(fact)[:2] == (20, 20)
    for bad in (segment(3, 22, u32(20, 20, 0, 0) + bytes(30)), segment(3, 6, u32(20, 20, 0, 0) + b"\0\0\1" + u32(1) + bytes(9))):
        with pytest.raises(PdfError, match="segment 3 of type"):
            rasters.pixels(fact | {"data": good + bad})
        assert (bits(jbig2.decode(good + bad)) == image).all() and not jbig2.inspect(good + bad)["supported"]
