"""JBIG2 as PDF embeds it: generic regions (arithmetic and MMR), symbol dictionaries, text regions and refinement
of regions and of a text's symbols. Halftones, Huffman coding and dictionaries of refined symbols are not decoded;
a bad segment harms no other, and ``decode_page`` tells what was left out. Bitmaps are rows of 0 and 1, 1 for black."""

from __future__ import annotations

import numpy as np

from vellum.kernel import ccitt
from vellum.kernel.objects import PdfError

_QE = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]
_MOST = 1 << 27


class Mq:
    """The arithmetic decoder; a context is a list of (state << 1 | more probable bit)."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.c = (data[0] if data else 0xFF) << 16
        self.count = self.beyond = 0
        self._byte()
        self.c <<= 7
        self.count -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        d, p = self.data, self.at
        self.beyond += p >= len(d)
        if self.beyond > 4096:
            raise PdfError("JBIG2 data ends too soon")
        here = d[p] if p < len(d) else 0xFF
        after = d[p + 1] if p + 1 < len(d) else 0xFF
        if here == 0xFF and after > 0x8F:
            self.c += 0xFF00
            self.count = 8
        else:
            self.at = p + 1
            self.c += after << (9 if here == 0xFF else 8)
            self.count = 7 if here == 0xFF else 8

    def bit(self, contexts: list[int], i: int) -> int:
        s = contexts[i]
        qe, more, less, switch = _QE[s >> 1]
        d = s & 1
        self.a -= qe
        if (self.c >> 16) < qe:
            likely = self.a < qe
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return d
            likely = self.a >= qe
        if likely:
            contexts[i] = more << 1 | d
        else:
            contexts[i] = less << 1 | (d ^ switch)
            d ^= 1
        while True:
            if not self.count:
                self._byte()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.count -= 1
            if self.a & 0x8000:
                return d


class Integers:
    """Arithmetic integers, a set of contexts for each name; None says out of band."""

    def __init__(self, mq: Mq):
        self.mq, self.contexts = mq, {}

    def read(self, name: str) -> int | None:
        c = self.contexts.setdefault(name, [0] * 512)
        before = 1

        def bit() -> int:
            nonlocal before
            d = self.mq.bit(c, before)
            before = before << 1 | d if before < 256 else ((before << 1 | d) & 511) | 256
            return d

        sign = bit()
        for bits, base in ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340)):
            if not bit():
                break
        else:
            bits, base = 32, 4436
        v = 0
        for _ in range(bits):
            v = v << 1 | bit()
        v += base
        return v if not sign else -v if v else None

    def symbol(self, bits: int) -> int:
        c, before = self.contexts.setdefault("IAID", [0] * (2 << bits)), 1
        for _ in range(bits):
            before = before << 1 | self.mq.bit(c, before)
        return before - (1 << bits)


#: (pixels of the template by row, those of them that are adaptive, context of the typical row's bit).
_TEMPLATES = [
    ([(x, -2) for x in range(-2, 3)] + [(x, -1) for x in range(-3, 4)] + [(x, 0) for x in range(-4, 0)], [(3, -1), (-3, -1), (2, -2), (-2, -2)], 0x9B25),
    ([(x, -2) for x in range(-1, 3)] + [(x, -1) for x in range(-2, 4)] + [(x, 0) for x in range(-3, 0)], [(3, -1)], 0x0795),
    ([(x, -2) for x in range(-1, 2)] + [(x, -1) for x in range(-2, 3)] + [(x, 0) for x in range(-2, 0)], [(2, -1)], 0x00E5),
    ([(x, -1) for x in range(-3, 3)] + [(x, 0) for x in range(-4, 0)], [(2, -1)], 0x0195),
]


def generic(mq: Mq, contexts: list[int], width: int, height: int, template: int, adaptive: list[tuple[int, int]], typical: bool = False) -> np.ndarray:
    """A generic region, pixel by pixel."""
    if width * height > _MOST:
        raise PdfError("region too large")
    pixels, movable, repeat = _TEMPLATES[template]
    place = dict(zip(movable, adaptive))
    pixels = [place.get(p, p) for p in pixels]
    pad = 130
    rows = [[0] * (width + 2 * pad)] * 130
    out, same = [], 0
    for _ in range(height):
        if typical:
            same ^= mq.bit(contexts, repeat)
            if same:
                rows.append(rows[-1])
                out.append(rows[-1][pad : pad + width])
                continue
        row = [0] * (width + 2 * pad)
        rows.append(row)
        sources = [(rows[y - 1], x + pad) for x, y in pixels]
        for x in range(width):
            c = 0
            for r, dx in sources:
                c = c << 1 | r[x + dx]
            row[x + pad] = mq.bit(contexts, c)
        out.append(row[pad : pad + width])
        rows = rows[-130:]
    return np.array(out, np.uint8).reshape(height, width)


#: Pixels of the refinement templates: of the region that is made, and of the one that it refines. Adaptive ones
#: come last in each part of the first template.
_REFINE = [
    ([(0, -1), (1, -1), (-1, 0)], [(0, -1), (1, -1), (-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)], 0x20),
    ([(-1, -1), (0, -1), (1, -1), (-1, 0)], [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1), (1, 1)], 0x08),
]


def refinement(mq: Mq, contexts: list[int], width: int, height: int, template: int, base: np.ndarray, dx: int, dy: int, adaptive: list[tuple[int, int]], typical: bool = False) -> np.ndarray:
    """A region that refines ``base``, which lies at (dx, dy) in it."""
    if width * height > _MOST:
        raise PdfError("region too large")
    own, other, repeat = _REFINE[template]
    if not template:
        own, other = [*own, adaptive[0]], [*other, adaptive[1]]
    far = 130
    under = np.zeros((height + 2 * far, width + 2 * far), np.uint8)
    y0, x0 = max(0, dy + far), max(0, dx + far)
    part = base[y0 - dy - far : y0 - dy - far + under.shape[0] - y0, x0 - dx - far : x0 - dx - far + under.shape[1] - x0] if y0 < under.shape[0] and x0 < under.shape[1] else base[:0, :0]
    under[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]] = part
    below = under.tolist()
    out = [[0] * (width + 2 * far) for _ in range(height + far)]
    same = 0
    for y in range(height):
        row = out[y + far]
        if typical:
            same ^= mq.bit(contexts, repeat)
        first = [(out[y + far + v], u + far) for u, v in own]
        second = [(below[y + far + v], u + far) for u, v in other]
        around = [below[y + far + v] for v in (-1, 0, 1)]
        for x in range(width):
            if same:
                total = sum(r[x + far - 1] + r[x + far] + r[x + far + 1] for r in around)
                if total in (0, 9):
                    row[x + far] = total // 9
                    continue
            c = 0
            for r, u in first:
                c = c << 1 | r[x + u]
            for r, u in second:
                c = c << 1 | r[x + u]
            row[x + far] = mq.bit(contexts, c)
    return np.array([r[far : far + width] for r in out[far:]], np.uint8).reshape(height, width)


def segments(data: bytes) -> list[dict]:
    """Headers and data of a sequence of segments; stops where they make no sense."""
    out, p = [], 0
    number = lambda a, n: int.from_bytes(data[a : a + n], "big")
    if data[:8] == b"\x97JB2\r\n\x1a\n":
        p = 9 if data[8] & 2 else 13
    while p + 11 <= len(data):
        ident, flags, n = number(p, 4), data[p + 4], data[p + 5] >> 5
        p += 5
        if n == 7:
            n = number(p, 4) & 0x1FFFFFFF
            p += 4 + (n + 8) // 8
        else:
            p += 1
        size = 1 if ident <= 256 else 2 if ident <= 65_536 else 4
        if n > 10_000 or p + n * size > len(data):
            break
        refs = [number(p + size * i, size) for i in range(n)]
        p += n * size
        page = number(p, 4 if flags & 64 else 1)
        p += 4 if flags & 64 else 1
        length = number(p, 4)
        p += 4
        if length == 0xFFFFFFFF:
            length = len(data) - p
        out.append({"number": ident, "type": flags & 63, "page": page, "refers": refs, "data": data[p : p + length]})
        p += length
    return out


class _Page:
    def __init__(self):
        self.bitmap = np.zeros((0, 0), np.uint8)
        self.symbols: dict[int, list[np.ndarray]] = {}
        self.regions: dict[int, np.ndarray] = {}
        #: Of a page whose height is told by its stripes only: the colour of new rows, and where it ends.
        self.grows: int | None = None
        self.end = 0

    def finish(self) -> np.ndarray:
        """The page; one of unknown height as high as its last stripe or its lowest region says."""
        if self.grows is not None and self.end:
            self.grow(self.end)
            self.bitmap = self.bitmap[: self.end]
        return self.bitmap

    def grow(self, height: int) -> None:
        h, w = self.bitmap.shape
        if height > h:
            if height * w > _MOST:
                raise PdfError("page too large")
            self.bitmap = np.concatenate([self.bitmap, np.full((height - h, w), self.grows or 0, np.uint8)])

    def put(self, b: np.ndarray, x: int, y: int, how: int, onto: np.ndarray | None = None) -> None:
        page = self.bitmap if onto is None else onto
        h, w = page.shape
        x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + b.shape[1]), min(h, y + b.shape[0])
        if x0 >= x1 or y0 >= y1:
            return
        part, new = page[y0:y1, x0:x1], b[y0 - y : y1 - y, x0 - x : x1 - x]
        page[y0:y1, x0:x1] = part | new if how == 0 else part & new if how == 1 else part ^ new if how == 2 else 1 - (part ^ new) if how == 3 else new

    def segment(self, s: dict) -> None:
        d, kind = s["data"], s["type"]
        number = lambda p: int.from_bytes(d[p : p + 4], "big")
        if kind == 48:
            w, h = number(0), number(4)
            if h == 0xFFFFFFFF:
                h, self.grows = 0, d[16] >> 2 & 1
            if w * h > _MOST:
                raise PdfError("page too large")
            self.bitmap = np.full((h, w), d[16] >> 2 & 1, np.uint8)
        elif kind == 50:
            self.end = max(self.end, number(0) + 1)
        elif kind == 0:
            self.symbols[s["number"]] = self._dictionary(d, [b for r in s["refers"] for b in self.symbols.get(r, [])])
        elif kind in (4, 6, 7, 36, 38, 39):
            w, h, x, y, how = number(0), number(4), number(8), number(12), d[16] & 7
            self._room(w, h, y)
            made = self._generic(d[17:], w, h) if kind > 30 else self._text(d[17:], w, h, [b for r in s["refers"] for b in self.symbols.get(r, [])])
            if kind in (4, 36):  # kept for a refinement
                self.regions[s["number"]] = made
            else:
                self.put(made, x, y, how)
        elif kind in (40, 42, 43):
            w, h, x, y, how = number(0), number(4), number(8), number(12), d[16] & 7
            self._room(w, h, y)
            template, typical = d[17] & 1, bool(d[17] & 2)
            adaptive = [] if template else self._pairs(d, 18, 2)
            known = [self.regions[r] for r in s["refers"] if r in self.regions]
            base = known[0] if known else self.bitmap[y : y + h, x : x + w].copy()
            made = refinement(Mq(d[18 + 2 * len(adaptive) :]), [0] * 8192, w, h, template, base, 0, 0, adaptive, typical)
            if kind == 40:
                self.regions[s["number"]] = made
            else:
                self.put(made, x, y, how if known else 4)
        elif kind in (16, 20, 22, 23):
            raise PdfError("unsupported halftone")

    def _room(self, w: int, h: int, y: int) -> None:
        """Checks a region's size, and makes room for it on a page that grows."""
        if w * h > max(4 * self.bitmap.size, 1 << 12) and (self.grows is None or w * h > _MOST):
            raise PdfError("region too large for its page")
        if self.grows is not None and y + h <= 1 << 20:
            self.grow(y + h)

    @staticmethod
    def _pairs(d: bytes, p: int, n: int) -> list[tuple[int, int]]:
        v = np.frombuffer(d[p : p + 2 * n], np.int8).tolist()
        return list(zip(v[::2], v[1::2]))

    def _generic(self, d: bytes, w: int, h: int) -> np.ndarray:
        flags = d[0]
        if flags & 1:
            _, rows, packed = ccitt.decode(d[1:], -1, w, h, True)
            out = np.zeros((h, w), np.uint8)
            if rows:
                out[:rows] = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(rows, -1), axis=1)[:, :w]
            return out
        template = flags >> 1 & 3
        n = len(_TEMPLATES[template][1])
        return generic(Mq(d[1 + 2 * n :]), [0] * 65_536, w, h, template, self._pairs(d, 1, n), bool(flags & 8))

    def _dictionary(self, d: bytes, known: list[np.ndarray]) -> list[np.ndarray]:
        flags = int.from_bytes(d[:2], "big")
        if flags & 3:
            raise PdfError("unsupported symbol dictionary")
        template = flags >> 10 & 3
        n = len(_TEMPLATES[template][1])
        adaptive, p = self._pairs(d, 2, n), 2 + 2 * n
        exported, fresh = int.from_bytes(d[p : p + 4], "big"), int.from_bytes(d[p + 4 : p + 8], "big")
        if fresh > 1 << 20:
            raise PdfError("too many symbols")
        mq = Mq(d[p + 8 :])
        ints, contexts, every, height = Integers(mq), [0] * 65_536, list(known), 0
        while len(every) < len(known) + fresh:
            height += ints.read("IADH") or 0
            width = 0
            while (step := ints.read("IADW")) is not None and len(every) < len(known) + fresh:
                width += step
                if width < 0 or height < 0 or width * height > 1 << 20:
                    raise PdfError("broken symbol")
                every.append(generic(mq, contexts, width, height, template, adaptive))
            if step is not None:
                break
        out, i, on = [], 0, False
        while i < len(every) and len(out) < exported:
            n = ints.read("IAEX")
            if n is None or n < 0:
                break
            out += every[i : i + n] if on else []
            i, on = i + n, not on
        return out

    def _text(self, d: bytes, w: int, h: int, symbols: list[np.ndarray]) -> np.ndarray:
        flags = int.from_bytes(d[:2], "big")
        if flags & 1:
            raise PdfError("unsupported text region")
        refine, strips, corner, across, how = flags & 2, 1 << (flags >> 2 & 3), flags >> 4 & 3, flags & 64, flags >> 7 & 3
        offset = (flags >> 10 & 31) - (32 if flags >> 14 & 1 else 0)
        template = flags >> 15 & 1
        adaptive = self._pairs(d, 2, 2) if refine and not template else []
        p = 2 + 2 * len(adaptive)
        count = int.from_bytes(d[p : p + 4], "big")
        out = np.full((h, w), flags >> 9 & 1, np.uint8)
        ints, contexts, bits = Integers(Mq(d[p + 4 :])), [0] * 8192, max(0, (len(symbols) - 1).bit_length()) if symbols else 0
        t, first, done = -(ints.read("IADT") or 0) * strips, 0, 0
        while done < min(count, 1 << 22):
            t += (ints.read("IADT") or 0) * strips
            first += ints.read("IAFS") or 0
            s = first
            while True:
                at = t + ((ints.read("IAIT") or 0) if strips > 1 else 0)
                i = ints.symbol(bits)
                b = symbols[i] if i < len(symbols) else None
                if refine and ints.read("IARI"):
                    more_w, more_h, dx, dy = (ints.read(k) or 0 for k in ("IARDW", "IARDH", "IARDX", "IARDY"))
                    if b is None or not 0 < b.shape[1] + more_w <= 1 << 14 or not 0 < b.shape[0] + more_h <= 1 << 14:
                        raise PdfError("broken refinement")
                    b = refinement(ints.mq, contexts, b.shape[1] + more_w, b.shape[0] + more_h, template, b, (more_w >> 1) + dx, (more_h >> 1) + dy, adaptive)
                if b is not None:
                    bh, bw = b.shape
                    far = bh - 1 if across else bw - 1
                    if (corner in (0, 2)) if across else (corner in (2, 3)):
                        s += far
                    x, y = (at, s) if across else (s, at)
                    self.put(b, x - (bw - 1 if corner in (2, 3) else 0), y - (bh - 1 if corner in (0, 2) else 0), how, out)
                    if (corner in (1, 3)) if across else (corner in (0, 1)):
                        s += far
                done += 1
                step = ints.read("IADS")
                if step is None or done >= count:
                    break
                s += step + offset
        return out


def decode(data: bytes, globals_: bytes | None = None) -> tuple[int, int, bytes]:
    """(width, height, packed bits), 1 for black, of all segments that can be decoded."""
    return decode_page(data, globals_)[:3]


def decode_page(data: bytes, globals_: bytes | None = None) -> tuple[int, int, bytes, list[str]]:
    """The same, with what is missing from it: a line for each segment that was left out, and why."""
    page, missing = _Page(), []
    for s in segments(globals_ or b"") + segments(data):
        try:
            page.segment(s)
        except (PdfError, IndexError, ValueError, TypeError, OverflowError, MemoryError) as e:
            missing.append(f"segment {s['number']} of type {s['type']}: {e or type(e).__name__}")
    h, w = page.finish().shape
    if not h:
        raise PdfError("no JBIG2 page")
    return w, h, np.packbits(page.bitmap, axis=1).tobytes(), missing


def inspect(data: bytes, globals_: bytes | None = None) -> dict:
    """What the segments use, and whether ``decode`` has all of it."""
    found = segments(globals_ or b"") + segments(data)
    flags = lambda s, p: int.from_bytes(s["data"][p : p + 2], "big")
    huffman = any((s["type"] == 0 and flags(s, 0) & 1) or (s["type"] in (4, 6, 7) and flags(s, 17) & 1) for s in found)
    refined = any(s["type"] in (40, 42, 43) or (s["type"] in (4, 6, 7) and flags(s, 17) & 2) for s in found)
    symbols = any(s["type"] == 0 and flags(s, 0) & 2 for s in found)
    halftone = any(s["type"] in (16, 20, 22, 23) for s in found)
    return {"types": [s["type"] for s in found], "huffman": huffman, "refinement": refined or symbols, "halftone": halftone, "supported": bool(found) and not (huffman or symbols or halftone)}
