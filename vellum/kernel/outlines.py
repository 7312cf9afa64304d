"""Glyph outlines of TrueType, CFF and Type 1 programs. A contour is a list of segments ((x, y), ...): two
points for a line, three for a quadratic, four for a cubic curve. Everything is in font units."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from vellum.kernel.hinting import Fault, Machine
from vellum.kernel.objects import PdfError

Contours = list[list[tuple]]
#: Names of Adobe's standard encoding and, in its order, the first CFF strings.
STANDARD_STRINGS = (
    ".notdef space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at "
    "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z bracketleft backslash bracketright asciicircum underscore quoteleft a b c d e f g h i j k l m n o p q r s t u v w x y z braceleft bar braceright asciitilde exclamdown cent sterling fraction yen "
    "florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown grave "
    "acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls"
).split()
_CODES = [*range(32, 127), *range(161, 176), *range(177, 181), *range(182, 190), 191, 193, *range(194, 201), 202, 203, 205, 206, 207, 208, 225, 227, *range(232, 236), 241, 245, *range(248, 252)]
STANDARD_ENCODING = dict(zip(_CODES, STANDARD_STRINGS[1:]))


@dataclass
class Glyph:
    contours: Contours = field(default_factory=list)
    advance: float = 0.0

    def scaled(self, by: float) -> Glyph:
        return Glyph([[tuple((x * by, y * by) for x, y in s) for s in c] for c in self.contours], float(round(self.advance * by)))


def _u16(d: bytes, p: int) -> int:
    return int.from_bytes(d[p : p + 2], "big")


def _s16(d: bytes, p: int) -> int:
    return int.from_bytes(d[p : p + 2], "big", signed=True)


def _u32(d: bytes, p: int) -> int:
    return int.from_bytes(d[p : p + 4], "big")


def tables(data: bytes) -> dict[str, bytes]:
    """The tables of an sfnt file; of a collection the first font's."""
    at = _u32(data, 12) if data[:4] == b"ttcf" else 0
    return {data[p : p + 4].decode("latin-1"): data[_u32(data, p + 8) : _u32(data, p + 8) + _u32(data, p + 12)] for p in range(at + 12, at + 12 + 16 * min(_u16(data, at + 4), 200), 16) if p + 16 <= len(data)}


def cmap(d: bytes) -> dict[int, int]:
    """Code to glyph, of the best subtable of format 0, 4, 6 or 12."""
    best: tuple[int, dict[int, int]] = (-1, {})
    rank = {(3, 10): 5, (0, 4): 4, (3, 1): 4, (0, 3): 3, (3, 0): 2, (1, 0): 1}
    for i in range(min(_u16(d, 2), 64)):
        p = 4 + 8 * i
        score = rank.get((_u16(d, p), _u16(d, p + 2)), 0)
        t = d[_u32(d, p + 4) :]
        out: dict[int, int] = {}
        match _u16(t, 0):
            case 0:
                out = {c: g for c, g in enumerate(t[6:262]) if g}
            case 4:
                n = _u16(t, 6) // 2
                for k in range(n):
                    end, start = _u16(t, 14 + 2 * k), _u16(t, 16 + 2 * n + 2 * k)
                    delta, at = _u16(t, 16 + 4 * n + 2 * k), 16 + 6 * n + 2 * k
                    offset = _u16(t, at)
                    for c in range(start, min(end, 0xFFFE) + 1):
                        g = (c + delta) & 0xFFFF if not offset else _u16(t, at + offset + 2 * (c - start))
                        if offset and g:
                            g = (g + delta) & 0xFFFF
                        if g:
                            out[c] = g
            case 6:
                out = {_u16(t, 6) + k: g for k in range(_u16(t, 8)) if (g := _u16(t, 10 + 2 * k))}
            case 12:
                for k in range(min(_u32(t, 12), 100_000)):
                    a, b, g = (_u32(t, 16 + 12 * k + 4 * j) for j in range(3))
                    out |= {a + j: g + j for j in range(min(b - a + 1, 70_000))}
        if out and score > best[0]:
            best = (score, out)
    return best[1]


class TrueType:
    def __init__(self, data: bytes):
        t = tables(data)
        if not {"head", "maxp", "loca", "glyf"} <= set(t):
            raise PdfError("no TrueType outlines")
        self.units = _u16(t["head"], 18) or 1000
        self.count = _u16(t["maxp"], 4)
        size = 4 if _s16(t["head"], 50) else 2
        raw = t["loca"][: (self.count + 1) * size]
        self.loca = (np.frombuffer(raw, ">u4") if size == 4 else np.frombuffer(raw, ">u2").astype(np.int64) * 2).tolist()
        self.glyf, self.hmtx, self.wide = t["glyf"], t.get("hmtx", b""), _u16(t["hhea"], 34) if len(t.get("hhea", b"")) >= 36 else 0
        self.codes = cmap(t["cmap"]) if "cmap" in t else {}
        cvt, most = t.get("cvt ", b""), t["maxp"]
        self.hints = {"cvt": [_s16(cvt, i) for i in range(0, len(cvt) - 1, 2)], "font": t.get("fpgm", b""), "size": t.get("prep", b""), "twilight": _u16(most, 16), "storage": _u16(most, 18), "stack": _u16(most, 24)}
        self.machine: tuple[int, Machine | None] = (0, None)

    def advance(self, g: int) -> float:
        return float(_u16(self.hmtx, 4 * min(g, self.wide - 1))) if self.wide else 0.0

    def glyph(self, g: int) -> Glyph:
        return Glyph(self._contours(g, 0), self.advance(g))

    def _contours(self, g: int, depth: int) -> Contours:
        if depth > 8 or not 0 <= g < len(self.loca) - 1:
            return []
        d = self.glyf[self.loca[g] : self.loca[g + 1]]
        if len(d) < 10:
            return []
        n = _s16(d, 0)
        return self._composite(d, depth) if n < 0 else self._simple(d, n)

    def _points(self, d: bytes, n: int) -> tuple[list[tuple[float, float, bool]], list[int], bytes]:
        """The points of a simple glyph, the last of each contour, and its instructions."""
        ends = [_u16(d, 10 + 2 * i) for i in range(n)]
        total = ends[-1] + 1 if ends else 0
        p = 10 + 2 * n
        program = d[p + 2 : p + 2 + _u16(d, p)]
        p += 2 + _u16(d, p)
        flags: list[int] = []
        while len(flags) < total and p < len(d):
            f, p = d[p], p + 1
            flags.append(f)
            if f & 8 and p < len(d):
                flags += [f] * d[p]
                p += 1
        flags = flags[:total]
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, out = 0, []
            for f in flags:
                if f & short:
                    v += (d[p] if p < len(d) else 0) * (1 if f & same else -1)
                    p += 1
                elif not f & same:
                    v += _s16(d, p)
                    p += 2
                out.append(v)
            axes.append(out)
        return [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags)], ends, program

    def _simple(self, d: bytes, n: int) -> Contours:
        points, ends, _ = self._points(d, n)
        return _closed(points, ends)

    def hinted(self, g: int, ppem: int) -> Glyph:
        """A simple glyph fitted to the grid at so many pixels to the em, in 64ths of a pixel. Composite glyphs, fonts
        without instructions and programs at fault give the scaled outline."""
        d = self.glyf[self.loca[g] : self.loca[g + 1]] if 0 <= g < len(self.loca) - 1 else b""
        if len(d) >= 10 and _s16(d, 0) >= 0 and (self.hints["font"] or self.hints["size"]):
            points, ends, program = self._points(d, _s16(d, 0))
            try:
                if self.machine[0] != ppem:
                    self.machine = (ppem, None)
                    self.machine = (ppem, Machine(self.units, ppem, **self.hints))
                if self.machine[1] is not None:
                    now, on = self.machine[1].fit([(int(x), int(y)) for x, y, _ in points], [c for *_, c in points], ends, self.bearing(g), int(self.advance(g)), program)
                    return Glyph(_closed([(float(x), float(y), c) for (x, y), c in zip(now, on)], ends), float(round(self.advance(g) * ppem * 64 / self.units)))
            except Fault:
                pass
        return self.glyph(g).scaled(ppem * 64 / self.units)

    def bearing(self, g: int) -> int:
        return _s16(self.hmtx, 4 * g + 2 if g < self.wide else 4 * self.wide + 2 * (g - self.wide))

    def _composite(self, d: bytes, depth: int) -> Contours:
        p, out, more = 10, [], True
        while more and p + 4 <= len(d):
            flags, g = _u16(d, p), _u16(d, p + 2)
            p += 4
            if flags & 1:
                dx, dy, p = _s16(d, p), _s16(d, p + 2), p + 4
            else:
                dx, dy, p = int.from_bytes(d[p : p + 1], "big", signed=True), int.from_bytes(d[p + 1 : p + 2], "big", signed=True), p + 2
            a, b, c, e = 1.0, 0.0, 0.0, 1.0
            if flags & 8:
                a = e = _s16(d, p) / 16384
                p += 2
            elif flags & 0x40:
                a, e, p = _s16(d, p) / 16384, _s16(d, p + 2) / 16384, p + 4
            elif flags & 0x80:
                a, b, c, e = (_s16(d, p + 2 * i) / 16384 for i in range(4))
                p += 8
            if not flags & 2:
                dx = dy = 0
            for contour in self._contours(g, depth + 1):
                out.append([tuple((x * a + y * c + dx, x * b + y * e + dy) for x, y in s) for s in contour])
            more = bool(flags & 0x20)
        return out


def _closed(points: list[tuple[float, float, bool]], ends: list[int]) -> Contours:
    return [c for a, e in zip([-1, *ends], ends) if (c := quadratic(points[a + 1 : e + 1]))]


def quadratic(points: list[tuple[float, float, bool]]) -> list[tuple]:
    """A closed contour of on- and off-curve points; between two that are off lies one that is on."""
    if len(points) < 2:
        return []
    full: list[tuple[float, float, bool]] = []
    for (x0, y0, on0), (x1, y1, on1) in zip(points, points[1:] + points[:1]):
        full.append((x0, y0, on0))
        if not on0 and not on1:
            full.append(((x0 + x1) / 2, (y0 + y1) / 2, True))
    first = next((i for i, p in enumerate(full) if p[2]), None)
    if first is None:
        return []
    full = full[first:] + full[:first] + [full[first]]
    out, i = [], 0
    while i + 1 < len(full):
        a, b = full[i][:2], full[i + 1]
        if b[2]:
            out.append((a, b[:2]))
            i += 1
        else:
            out.append((a, b[:2], full[i + 2][:2]))
            i += 2
    return out


def index(d: bytes, p: int) -> tuple[list[bytes], int]:
    """A CFF INDEX and where it ends."""
    n = _u16(d, p)
    if not n:
        return [], p + 2
    size = d[p + 2]
    at = [int.from_bytes(d[p + 3 + size * i : p + 3 + size * (i + 1)], "big") for i in range(n + 1)]
    base = p + 2 + size * (n + 1)
    return [d[base + a : base + b] for a, b in zip(at, at[1:])], base + at[-1]


def dictionary(d: bytes) -> dict[int, list[float]]:
    """A CFF DICT; operators of two bytes are 1200 and above."""
    out, args, p = {}, [], 0
    while p < len(d):
        b = d[p]
        p += 1
        if b <= 21:
            op = b
            if b == 12 and p < len(d):
                op, p = 1200 + d[p], p + 1
            out[op], args = args, []
        elif b == 28:
            args.append(_s16(d, p))
            p += 2
        elif b == 29:
            args.append(int.from_bytes(d[p : p + 4], "big", signed=True))
            p += 4
        elif b == 30:
            text = ""
            while p < len(d) and "f" not in text:
                text += d[p : p + 1].hex()
                p += 1
            t = text.split("f")[0].replace("a", ".").replace("b", "E").replace("c", "E-").replace("e", "-")
            args.append(float(t) if re.fullmatch(r"-?\d*\.?\d*(E-?\d+)?", t) and re.search(r"\d", t) else 0.0)
        elif b >= 32:
            if b <= 246:
                args.append(b - 139)
            else:
                args.append((b - 247) * 256 + d[p] + 108 if b <= 250 else -(b - 251) * 256 - d[p] - 108)
                p += 1
    return out


class _Pen:
    """Builds contours from relative moves; a move closes what is open."""

    def __init__(self):
        self.x = self.y = 0.0
        self.contours: Contours = []
        self.open: list[tuple] = []
        self.start = (0.0, 0.0)

    def close(self) -> None:
        if self.open:
            if (self.x, self.y) != self.start:
                self.open.append(((self.x, self.y), self.start))
            self.contours.append(self.open)
        self.open = []

    def move(self, dx: float, dy: float) -> None:
        self.close()
        self.x, self.y = self.x + dx, self.y + dy
        self.start = (self.x, self.y)

    def line(self, dx: float, dy: float) -> None:
        a = (self.x, self.y)
        self.x, self.y = self.x + dx, self.y + dy
        self.open.append((a, (self.x, self.y)))

    def curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        p = (self.x, self.y)
        q = (p[0] + a, p[1] + b)
        r = (q[0] + c, q[1] + d)
        self.x, self.y = r[0] + e, r[1] + f
        self.open.append((p, q, r, (self.x, self.y)))


class Cff:
    def __init__(self, data: bytes):
        if data[:4] == b"OTTO":
            data = tables(data).get("CFF ", b"")
        if len(data) < 4:
            raise PdfError("no CFF program")
        _, p = index(data, data[2])
        tops, p = index(data, p)
        strings, p = index(data, p)
        self.globals, _ = index(data, p)
        self.top = dictionary(tops[0])
        self.charstrings, _ = index(data, int(self.top[17][0]))
        self.units = round(1 / m[0]) if (m := self.top.get(1207)) and m[0] else 1000
        n = len(self.charstrings)
        self.cid = 1230 in self.top
        name = lambda sid: STANDARD_STRINGS[sid] if sid < len(STANDARD_STRINGS) else strings[sid - 391].decode("latin-1") if 391 <= sid < 391 + len(strings) else f"sid{sid}"
        charset = self._charset(data, int(self.top.get(15, [0])[0]), n)
        self.names = {c if self.cid else name(c): g for g, c in reversed(list(enumerate(charset)))}
        if self.cid:
            fonts, _ = index(data, int(self.top[1236][0]))
            self.private = [self._private(data, dictionary(f)) for f in fonts]
            self.select = self._select(data, int(self.top[1237][0]), n)
        else:
            self.private, self.select = [self._private(data, self.top)], [0] * n
        self.codes = {c: self.names[s] for c, s in STANDARD_ENCODING.items() if s in self.names}

    @staticmethod
    def _private(data: bytes, d: dict) -> tuple[list[bytes], float, float]:
        size, at = (int(v) for v in d.get(18, [0, 0])[:2])
        p = dictionary(data[at : at + size])
        subrs = index(data, at + int(p[19][0]))[0] if 19 in p and p[19] else []
        first = lambda k: float(p[k][0]) if p.get(k) else 0.0
        return subrs, first(20), first(21)

    @staticmethod
    def _charset(d: bytes, p: int, n: int) -> list[int]:
        out = [0]
        if p <= 2:
            return list(range(n))
        kind, p = d[p], p + 1
        while len(out) < n and p + 1 < len(d):
            first = _u16(d, p)
            p += 2
            left = 0
            if kind:
                left = d[p] if kind == 1 else _u16(d, p)
                p += kind
            out += range(first, first + left + 1)
        return out[:n]

    @staticmethod
    def _select(d: bytes, p: int, n: int) -> list[int]:
        if d[p] == 0:
            return list(d[p + 1 : p + 1 + n])
        out: list[int] = []
        for i in range(_u16(d, p + 1)):
            q = p + 3 + 3 * i
            out += [d[q + 2]] * max(0, min(_u16(d, q + 3), n) - _u16(d, q))
        return out + [0] * (n - len(out))

    def glyph(self, g: int, depth: int = 0) -> Glyph:
        if not 0 <= g < len(self.charstrings):
            return Glyph()
        which = self.select[g] if self.select[g] < len(self.private) else 0
        subrs, default, nominal = self.private[which]
        pen, stack, width, hints, left = _Pen(), [], None, 0, 200_000
        bias = lambda s: 107 if len(s) < 1240 else 1131 if len(s) < 33_900 else 32_768

        def sized(even: int | None) -> None:
            nonlocal width
            if width is None:
                extra = len(stack) % 2 if even is None else len(stack) > even
                width = nominal + stack.pop(0) if extra and stack else default

        def run(code: bytes, level: int) -> bool:
            """Whether the glyph has ended."""
            nonlocal hints, left
            p = 0
            while p < len(code):
                left -= 1
                if left < 0 or level > 10:
                    return True
                b = code[p]
                p += 1
                if b == 28:
                    stack.append(_s16(code, p))
                    p += 2
                elif b == 255:
                    stack.append(int.from_bytes(code[p : p + 4], "big", signed=True) / 65_536)
                    p += 4
                elif b >= 32:
                    if b <= 246:
                        stack.append(b - 139)
                    else:
                        v = code[p] if p < len(code) else 0
                        stack.append((b - 247) * 256 + v + 108 if b <= 250 else -(b - 251) * 256 - v - 108)
                        p += 1
                elif b in (1, 3, 18, 23, 19, 20):
                    sized(None)
                    hints += len(stack) // 2
                    stack.clear()
                    if b in (19, 20):
                        p += (hints + 7) // 8
                elif b in (21, 22, 4):
                    sized(2 if b == 21 else 1)
                    if len(stack) >= (2 if b == 21 else 1):
                        pen.move(stack[-2] if b == 21 else stack[-1] if b == 22 else 0, 0 if b == 22 else stack[-1])
                    stack.clear()
                elif b == 10 or b == 29:
                    s = subrs if b == 10 else self.globals
                    i = int(stack.pop()) + bias(s) if stack else -1
                    if 0 <= i < len(s) and run(s[i], level + 1):
                        return True
                elif b == 11:
                    return False
                elif b == 14:
                    sized(4 if len(stack) >= 4 else 0)
                    pen.close()
                    if len(stack) >= 4 and depth == 0:
                        dx, dy, base, accent = stack[-4:]
                        for code_, ox, oy in ((base, 0, 0), (accent, dx, dy)):
                            g2 = self.names.get(STANDARD_ENCODING.get(int(code_), ""), -1)
                            pen.contours += [[tuple((x + ox, y + oy) for x, y in s) for s in c] for c in self.glyph(g2, 1).contours]
                    return True
                else:
                    if b == 12:
                        b = 1200 + (code[p] if p < len(code) else 0)
                        p += 1
                    draw(b)
                    stack.clear()
            return False

        def draw(b: int) -> None:
            s = stack
            if b == 5:
                for i in range(0, len(s) - 1, 2):
                    pen.line(s[i], s[i + 1])
            elif b in (6, 7):
                flat = b == 6
                for v in s:
                    pen.line(v if flat else 0, 0 if flat else v)
                    flat = not flat
            elif b in (8, 24):
                n = (len(s) - (2 if b == 24 else 0)) // 6 * 6
                for i in range(0, n, 6):
                    pen.curve(*s[i : i + 6])
                if b == 24 and len(s) >= n + 2:
                    pen.line(s[n], s[n + 1])
            elif b == 25:
                n = (len(s) - 6) // 2 * 2
                for i in range(0, n, 2):
                    pen.line(s[i], s[i + 1])
                if len(s) >= n + 6 and n >= 0:
                    pen.curve(*s[n : n + 6])
            elif b in (26, 27):
                i = len(s) % 4 and 1
                first = s[0] if i else 0
                while i + 4 <= len(s):
                    a, c, d, e = s[i : i + 4]
                    pen.curve(*((first, a, c, d, 0, e) if b == 26 else (a, first, c, d, e, 0)))
                    first, i = 0, i + 4
            elif b in (30, 31):
                flat, i = b == 31, 0
                while i + 4 <= len(s):
                    a, c, d, e = s[i : i + 4]
                    last = s[i + 4] if len(s) - i == 5 else 0
                    pen.curve(*((a, 0, c, d, last, e) if flat else (0, a, c, d, e, last)))
                    flat, i = not flat, i + 4
            elif b == 1235 and len(s) >= 12:
                pen.curve(*s[:6])
                pen.curve(*s[6:12])
            elif b == 1234 and len(s) >= 7:
                pen.curve(s[0], 0, s[1], s[2], s[3], 0)
                pen.curve(s[4], 0, s[5], -s[2], s[6], 0)
            elif b == 1236 and len(s) >= 9:
                pen.curve(s[0], s[1], s[2], s[3], s[4], 0)
                pen.curve(s[5], 0, s[6], s[7], s[8], -(s[1] + s[3] + s[7]))
            elif b == 1237 and len(s) >= 11:
                dx, dy = sum(s[0:10:2]), sum(s[1:10:2])
                pen.curve(*s[:6])
                pen.curve(*s[6:10], *((s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])))

        run(self.charstrings[g], 0)
        pen.close()
        return Glyph(pen.contours, float(default if width is None else width))


def decrypt(data: bytes, key: int, skip: int) -> bytes:
    out = bytearray()
    for c in data:
        out.append(c ^ (key >> 8))
        key = ((c + key) * 52_845 + 22_719) & 0xFFFF
    return bytes(out[skip:])


class Type1:
    def __init__(self, data: bytes):
        if data[:1] == b"\x80":  # PFB segments
            parts, p = [], 0
            while p + 6 <= len(data) and data[p] == 0x80 and data[p + 1] in (1, 2):
                n = int.from_bytes(data[p + 2 : p + 6], "little")
                parts.append(data[p + 6 : p + 6 + n])
                p += 6 + n
            data = b"".join(parts)
        at = data.find(b"eexec")
        if at < 0:
            raise PdfError("no Type 1 program")
        clear, secret = data[:at], data[at + 5 :].lstrip(b" \t\r\n")
        if re.fullmatch(rb"[0-9A-Fa-f\s]{8}", secret[:8]):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", secret)
            secret = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        private = decrypt(secret, 55_665, 4)
        m = re.search(rb"/lenIV\s+(-?\d+)", private)
        iv = int(m.group(1)) if m else 4
        m = re.search(rb"/FontMatrix\s*\[\s*([\d.eE+-]+)", clear)
        self.units = round(1 / float(m.group(1))) if m and float(m.group(1)) else 1000
        code = lambda b: b if iv < 0 else decrypt(b, 4330, iv)
        self.subrs: dict[int, bytes] = {}
        self.charstrings: dict[str, bytes] = {}
        begin = private.find(b"/CharStrings")
        for m in re.finditer(rb"dup\s+(\d+)\s+(\d+)\s+(?:RD|-\|)\s", private[: begin if begin >= 0 else len(private)]):
            self.subrs[int(m.group(1))] = code(private[m.end() : m.end() + int(m.group(2))])
        p = max(begin, 0)
        while m := re.compile(rb"/([^\s/]+)\s+(\d+)\s+(?:RD|-\|)\s").search(private, p):
            p = m.end() + int(m.group(2))
            self.charstrings.setdefault(m.group(1).decode("latin-1"), code(private[m.end() : p]))
        self.names = {n: n for n in self.charstrings}
        self.codes = {int(m.group(1)): m.group(2).decode("latin-1") for m in re.finditer(rb"dup\s+(\d+)\s*/(\S+)\s+put", clear)} or {c: n for c, n in STANDARD_ENCODING.items() if n in self.charstrings}

    def glyph(self, name: str, depth: int = 0) -> Glyph:
        pen, stack, ps, flex, state = _Pen(), [], [], [], {"width": 0.0, "flex": False, "left": 100_000, "bearing": 0.0}

        def move(dx: float, dy: float) -> None:
            if state["flex"]:
                pen.x, pen.y = pen.x + dx, pen.y + dy
                flex.append((pen.x, pen.y))
            else:
                pen.move(dx, dy)

        def run(code: bytes, level: int) -> bool:
            p = 0
            while p < len(code):
                state["left"] -= 1
                if level > 10 or state["left"] < 0:
                    return True
                b = code[p]
                p += 1
                if b >= 32:
                    if b <= 246:
                        stack.append(b - 139)
                    elif b < 255:
                        v = code[p] if p < len(code) else 0
                        stack.append((b - 247) * 256 + v + 108 if b <= 250 else -(b - 251) * 256 - v - 108)
                        p += 1
                    else:
                        stack.append(int.from_bytes(code[p : p + 4], "big", signed=True))
                        p += 4
                    continue
                if b == 12:
                    b = 1200 + (code[p] if p < len(code) else 0)
                    p += 1
                s = stack
                if b == 10:
                    i = int(s.pop()) if s else -1
                    if i in self.subrs and run(self.subrs[i], level + 1):
                        return True
                    continue
                if b == 11:
                    return False
                if b == 1212 and len(s) >= 2:
                    d = s.pop()
                    s.append(s.pop() / d if d else 0.0)
                    continue
                if b == 1216 and len(s) >= 2:
                    other, n = int(s.pop()), int(s.pop())
                    args = [s.pop() for _ in range(min(n, len(s)))]
                    if other == 1:
                        state["flex"] = True
                        flex.clear()
                    elif other == 0 and len(flex) >= 7:
                        state["flex"] = False
                        a = pen.open[-1][-1] if pen.open else pen.start
                        pen.open += [(a, flex[1], flex[2], flex[3]), (flex[3], flex[4], flex[5], flex[6])]
                        pen.x, pen.y = flex[6]
                        ps[:] = [pen.y, pen.x]
                    elif other == 3:
                        ps[:] = [3]
                    elif other != 2:
                        ps[:] = args
                    continue
                if b == 1217:
                    s.append(ps.pop() if ps else 0)
                    continue
                if b == 13 and len(s) >= 2:
                    pen.x = state["bearing"] = s[0]
                    state["width"] = s[1]
                elif b == 1207 and len(s) >= 4:
                    pen.x, pen.y, state["width"], state["bearing"] = s[0], s[1], s[2], s[0]
                elif b == 21 and len(s) >= 2:
                    move(s[-2], s[-1])
                elif b == 22 and s:
                    move(s[-1], 0)
                elif b == 4 and s:
                    move(0, s[-1])
                elif b == 5 and len(s) >= 2:
                    pen.line(s[0], s[1])
                elif b == 6 and s:
                    pen.line(s[0], 0)
                elif b == 7 and s:
                    pen.line(0, s[0])
                elif b == 8 and len(s) >= 6:
                    pen.curve(*s[:6])
                elif b == 30 and len(s) >= 4:
                    pen.curve(0, s[0], s[1], s[2], s[3], 0)
                elif b == 31 and len(s) >= 4:
                    pen.curve(s[0], 0, s[1], s[2], 0, s[3])
                elif b == 9:
                    x, y = pen.x, pen.y
                    pen.close()
                    pen.x, pen.y, pen.start = x, y, (x, y)
                elif b == 1233 and len(s) >= 2:
                    pen.x, pen.y = s[0], s[1]
                elif b == 1206 and len(s) >= 5 and depth == 0:
                    asb, dx, dy, base, accent = s[-5:]
                    for c, ox, oy in ((base, 0, 0), (accent, state["bearing"] - asb + dx, dy)):
                        part = self.glyph(STANDARD_ENCODING.get(int(c), ".notdef"), 1)
                        pen.contours += [[tuple((x + ox, y + oy) for x, y in seg) for seg in k] for k in part.contours]
                    return True
                elif b == 14:
                    pen.close()
                    return True
                s.clear()
            return False

        if name in self.charstrings:
            run(self.charstrings[name], 0)
            pen.close()
        return Glyph(pen.contours, float(state["width"]))


class Program:
    """A font program of any of the kinds, found by its first bytes."""

    def __init__(self, data: bytes):
        h = data[:4]
        if h in (b"\0\1\0\0", b"true", b"ttcf"):
            self.kind, self.font = "TrueType", TrueType(data)
        elif h == b"OTTO" or (len(data) > 4 and data[0] == 1 and data[2] >= 4 and data[3] in (1, 2, 3, 4)):
            self.kind, self.font = "CFF", Cff(data)
        elif h[:2] == b"%!" or h[:1] == b"\x80":
            self.kind, self.font = "Type1", Type1(data)
        else:
            raise PdfError("unknown font program")
        self.units = self.font.units

    def glyph(self, g) -> Glyph:
        return self.font.glyph(g)

    def hinted(self, g, ppem: int) -> Glyph:
        """A glyph in 64ths of a pixel, fitted to the grid if its program can do that."""
        if ppem <= 0:
            return Glyph()
        return self.font.hinted(g, ppem) if self.kind == "TrueType" else self.glyph(g).scaled(ppem * 64 / self.units)

    def by_code(self, code: int) -> Glyph:
        g = self.font.codes.get(code)
        return Glyph() if g is None else self.font.glyph(g)

    def by_name(self, name: str) -> Glyph:
        g = getattr(self.font, "names", {}).get(name)
        return Glyph() if g is None else self.font.glyph(g)
