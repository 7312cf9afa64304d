"""JPEG 2000, part 1: codestreams bare or in boxes, all progressions, both wavelets, coding styles of blocks,
regions of interest by shift, palettes. Samples come out at 8 bits, one after another by component."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from vellum.kernel.jbig2 import Mq
from vellum.kernel.objects import PdfError

_MOST = 1 << 28
_BYPASS, _RESET, _TERMINATE, _CAUSAL, _SEGMARK = 1, 2, 4, 8, 32


@dataclass
class Style:
    """How a component is coded (COD, COC) and quantised (QCD, QCC)."""

    order: int = 0
    layers: int = 1
    transform: int = 0
    sop: bool = False
    eph: bool = False
    levels: int = 0
    block: tuple[int, int] = (6, 6)
    flags: int = 0
    reversible: bool = True
    precincts: list[tuple[int, int]] = field(default_factory=list)
    quant: int = 0
    guard: int = 0
    steps: list[tuple[int, int]] = field(default_factory=list)
    shift: int = 0

    def copy(self) -> Style:
        return Style(**self.__dict__)


@dataclass
class Block:
    x0: int
    y0: int
    x1: int
    y1: int
    included: bool = False
    zero: int = 0
    passes: int = 0
    length_bits: int = 3
    #: Codeword segments: [most passes, passes so far, bytes].
    segments: list[list] = field(default_factory=list)


class TagTree:
    def __init__(self, w: int, h: int):
        self.sizes = [(w, h)]
        while w * h > 1:
            w, h = (w + 1) // 2, (h + 1) // 2
            self.sizes.append((w, h))
        self.value = [[0] * (a * b) for a, b in self.sizes]
        self.known = [[False] * (a * b) for a, b in self.sizes]

    def below(self, bits: Header, x: int, y: int, bound: int) -> bool:
        """Reads until the leaf's value is known or not below ``bound``; whether it is known and below."""
        low = 0
        for k in range(len(self.sizes) - 1, -1, -1):
            i = (y >> k) * self.sizes[k][0] + (x >> k)
            v = max(self.value[k][i], low)
            while not self.known[k][i] and v < bound:
                if bits.bit():
                    self.known[k][i] = True
                else:
                    v += 1
            self.value[k][i] = low = v
        return self.known[0][y * self.sizes[0][0] + x] and low < bound

    def read(self, bits: Header, x: int, y: int) -> int:
        bound = 1
        while not self.below(bits, x, y, bound):
            bound += 1
            if bound > 128:
                raise PdfError("broken tag tree")
        return self.value[0][y * self.sizes[0][0] + x]


class Header:
    """Bits of a packet header; a byte after 0xFF has seven."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.byte = data, at, 0, 0

    def bit(self) -> int:
        if not self.left:
            if self.at >= len(self.data):
                raise EOFError
            stuffed = self.byte == 0xFF
            self.byte = self.data[self.at]
            self.at += 1
            self.left = 7 if stuffed else 8
        self.left -= 1
        return self.byte >> self.left & 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def end(self) -> int:
        if self.byte == 0xFF:
            self.at += 1
        return self.at


def _up(a: int, b: int) -> int:
    return -(-a // b)


class Band:
    def __init__(self, kind: int, box: tuple[int, int, int, int], exponent: int, mantissa: int):
        self.kind, self.box, self.exponent, self.mantissa = kind, box, exponent, mantissa
        #: By precinct: (blocks by row, tag tree of inclusion, tag tree of zero planes).
        self.precincts: list[tuple[list[list[Block]], TagTree, TagTree]] = []


class Resolution:
    def __init__(self, box: tuple[int, int, int, int], wide: int, high: int, places: list[tuple[int, int]]):
        self.box, self.wide, self.high, self.places = box, wide, high, places
        self.bands: list[Band] = []


def component(style: Style, box: tuple[int, int, int, int], step: tuple[int, int], origin: tuple[int, int]) -> list[Resolution]:
    """Resolutions, bands, precincts and blocks of a tile's component. ``origin`` is the tile's corner on the
    reference grid, on which ``places`` of precincts are given."""
    out = []
    x0, y0, x1, y1 = box
    for r in range(style.levels + 1):
        d = 1 << (style.levels - r)
        rx0, ry0, rx1, ry1 = _up(x0, d), _up(y0, d), _up(x1, d), _up(y1, d)
        px, py = style.precincts[min(r, len(style.precincts) - 1)] if style.precincts else (15, 15)
        left, top = rx0 >> px, ry0 >> py
        wide, high = (_up(rx1, 1 << px) - left if rx1 > rx0 else 0), (_up(ry1, 1 << py) - top if ry1 > ry0 else 0)
        if wide * high > 1 << 20:
            raise PdfError("too many precincts")
        places = [(max(origin[1], (top + j) * (d << py) * step[1]), max(origin[0], (left + i) * (d << px) * step[0])) for j in range(high) for i in range(wide)]
        res = Resolution((rx0, ry0, rx1, ry1), wide, high, places)
        nb = d if r == 0 else 2 * d
        for kind in (0,) if r == 0 else (1, 2, 3):  # LL; HL, LH, HH
            ox, oy = (nb // 2 if kind & 1 else 0), (nb // 2 if kind & 2 else 0)
            b = _up(x0 - ox, nb), _up(y0 - oy, nb), _up(x1 - ox, nb), _up(y1 - oy, nb)
            i = 0 if r == 0 else 3 * (r - 1) + kind
            if style.quant == 1:  # derived from the first
                e, m = style.steps[0][0] - (0 if r == 0 else r - 1), style.steps[0][1]
            else:
                e, m = style.steps[min(i, len(style.steps) - 1)]
            band = Band(kind, b, e, m)
            ppx, ppy = (px, py) if r == 0 else (px - 1, py - 1)
            cx, cy = min(style.block[0], ppx), min(style.block[1], ppy)
            if cx < 0 or cy < 0:
                raise PdfError("broken precinct size")
            for j in range(high):
                for k in range(wide):
                    qx0, qy0 = max(b[0], (left + k) << ppx), max(b[1], (top + j) << ppy)
                    qx1, qy1 = min(b[2], (left + k + 1) << ppx), min(b[3], (top + j + 1) << ppy)
                    rows: list[list[Block]] = []
                    if qx1 > qx0 and qy1 > qy0:
                        for v in range(qy0 >> cy, _up(qy1, 1 << cy)):
                            rows.append([Block(max(u << cx, qx0), max(v << cy, qy0), min((u + 1) << cx, qx1), min((v + 1) << cy, qy1)) for u in range(qx0 >> cx, _up(qx1, 1 << cx))])
                    n, m2 = (len(rows[0]), len(rows)) if rows else (0, 0)
                    band.precincts.append((rows, TagTree(n, m2), TagTree(n, m2)))
            res.bands.append(band)
        out.append(res)
    return out


def sequence(parts: list[list[Resolution]], styles: list[Style], changes: list[tuple[int, ...]]) -> Iterator[tuple[int, int, int, int]]:
    """(layer, resolution, component, precinct) of the packets in their order."""
    s = styles[0]
    volumes = changes or [(0, 0, s.layers, 33, len(parts), s.order)]
    done: set[tuple[int, int, int, int]] = set()
    for r0, c0, l1, r1, c1, order in volumes:
        cells = [(r, c, p, *parts[c][r].places[p]) for c in range(c0, min(c1, len(parts))) for r in range(r0, min(r1, len(parts[c]))) for p in range(len(parts[c][r].places))]
        key = {0: None, 1: None, 2: lambda x: (x[0], x[3], x[4], x[1], x[2]), 3: lambda x: (x[3], x[4], x[1], x[0], x[2]), 4: lambda x: (x[1], x[3], x[4], x[0], x[2])}.get(order, 0)
        if key == 0:
            raise PdfError("unknown progression")
        cells.sort(key=key or (lambda x: (x[0], x[1], x[2])))
        layers = range(min(l1, s.layers))
        if order == 0:
            every = ((n, r, c, p) for n in layers for r, c, p, _, _ in cells)
        elif order == 1:
            every = ((n, r, c, p) for level in sorted({x[0] for x in cells}) for n in layers for r, c, p, _, _ in cells if r == level)
        else:
            every = ((n, r, c, p) for r, c, p, _, _ in cells for n in layers)
        for packet in every:
            if packet not in done:
                done.add(packet)
                yield packet


def _most(flags: int, first: int) -> int:
    """How many passes the segment has that begins with this pass."""
    if flags & _TERMINATE:
        return 1
    if flags & _BYPASS:
        return 10 - first if first < 10 else 2 if (first - 1) % 3 == 0 else 1
    return 1 << 30


def _new_passes(h: Header) -> int:
    if not h.bit():
        return 1
    if not h.bit():
        return 2
    if (v := h.bits(2)) < 3:
        return 3 + v
    if (v := h.bits(5)) < 31:
        return 6 + v
    return 37 + h.bits(7)


def packets(data: bytes, parts: list[list[Resolution]], styles: list[Style], changes: list[tuple[int, ...]]) -> None:
    """Reads a tile's packets into its blocks, as far as its data go."""
    at = 0
    for layer, r, c, p in sequence(parts, styles, changes):
        if at >= len(data):
            return
        if data[at : at + 2] == b"\xff\x91":
            at += 6
        h = Header(data, at)
        found: list[tuple[Block, list[tuple[list, int]]]] = []
        try:
            if h.bit():
                for band in parts[c][r].bands:
                    rows, included, zeros = band.precincts[p]
                    for y, row in enumerate(rows):
                        for x, b in enumerate(row):
                            if b.included:
                                if not h.bit():
                                    continue
                            elif not included.below(h, x, y, layer + 1):
                                continue
                            if not b.included:
                                b.included = True
                                b.zero = zeros.read(h, x, y)
                            n = _new_passes(h)
                            while h.bit():
                                b.length_bits += 1
                            took = []
                            while n:
                                if not b.segments or b.segments[-1][1] >= b.segments[-1][0]:
                                    b.segments.append([_most(styles[c].flags, b.passes), 0, b""])
                                s = b.segments[-1]
                                k = min(n, s[0] - s[1])
                                took.append((s, h.bits(b.length_bits + k.bit_length() - 1)))
                                s[1] += k
                                b.passes += k
                                n -= k
                            found.append((b, took))
        except EOFError:
            return
        at = h.end()
        if data[at : at + 2] == b"\xff\x92":
            at += 2
        for _, took in found:
            for s, length in took:
                s[2] += data[at : at + length]
                at += length


def _zero_contexts(kind: int) -> list[int]:
    """Context of a coefficient by its significant neighbours: beside, above and below, across corners."""
    out = []
    for h in range(3):
        for v in range(3):
            for d in range(5):
                if kind == 3:
                    n = h + v
                    out.append(8 if d >= 3 else (7 if n else 6) if d == 2 else 3 + min(n, 2) if d == 1 else min(n, 2))
                else:
                    a, b = (v, h) if kind == 1 else (h, v)
                    out.append(8 if a == 2 else (7 if b else 6 if d else 5) if a == 1 else 2 + b if b else min(d, 2))
    return out


_ZERO = [_zero_contexts(k) for k in range(4)]
#: (context, bit to flip) of a sign, by 3 (beside + 1) + (above and below + 1).
_SIGN = [(13, 1), (12, 1), (11, 1), (10, 1), (9, 0), (10, 0), (11, 0), (12, 0), (13, 0)]


def _fresh() -> list[int]:
    c = [0] * 19
    c[0], c[17], c[18] = 4 << 1, 3 << 1, 46 << 1
    return c


class _Raw:
    """Bits that are not arithmetically coded."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.byte = data, 0, 0, 0

    def bit(self, contexts: list[int], i: int) -> int:
        if not self.left:
            stuffed = self.byte == 0xFF
            self.byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
            self.left = 7 if stuffed else 8
        self.left -= 1
        return self.byte >> self.left & 1


def coefficients(b: Block, kind: int, flags: int, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """(magnitudes, doubled, with half of the last plane's bit added where planes are missing; signs)."""
    w, h = b.x1 - b.x0, b.y1 - b.y0
    stride = w + 2
    size = stride * (h + 2)
    sig, neg, mag, refined, last = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    seen = [-1] * size
    zero, causal = _ZERO[kind], flags & _CAUSAL
    contexts = _fresh()
    plane = planes - 1 - b.zero
    index = 0
    up, down = -stride, stride

    def look(i: int, bottom: bool) -> int:
        """Index into the table of zero contexts; below a stripe nothing is known in causal mode."""
        under = 0 if bottom else sig[i + down]
        corners = sig[i + up - 1] + sig[i + up + 1] + (0 if bottom else sig[i + down - 1] + sig[i + down + 1])
        return (sig[i - 1] + sig[i + 1]) * 15 + (sig[i + up] + under) * 5 + corners

    def sign(coder, i: int, bottom: bool) -> None:
        side = max(-1, min(1, sum(1 - 2 * neg[j] for j in (i - 1, i + 1) if sig[j])))
        rows = (i + up,) if bottom else (i + up, i + down)
        vert = max(-1, min(1, sum(1 - 2 * neg[j] for j in rows if sig[j])))
        if type(coder) is _Raw:
            neg[i] = coder.bit(contexts, 0)
        else:
            c, flip = _SIGN[3 * (side + 1) + vert + 1]
            neg[i] = coder.bit(contexts, c) ^ flip
        sig[i] = 1
        mag[i] = 1 << plane
        last[i] = plane

    coder = None
    for most, passes, data in b.segments:
        raw = bool(flags & _BYPASS) and index >= 10 and (index - 1) % 3 != 2
        coder = _Raw(data) if raw else Mq(data)
        for _ in range(passes):
            if plane < 0:
                break
            step = 2 if not index else (index - 1) % 3
            bit = coder.bit
            for top in range(0, h, 4):
                end = min(top + 4, h)
                for x in range(w):
                    i = (top + 1) * stride + x + 1
                    y = top
                    if step == 2 and end - top == 4:
                        column = range(i, i + 4 * stride, stride)
                        if not any(sig[j] or seen[j] == plane for j in column) and not any(look(j, bool(causal) and j == column[-1]) for j in column):
                            if not bit(contexts, 17):
                                continue
                            k = bit(contexts, 18) << 1
                            k |= bit(contexts, 18)
                            y += k
                            i += k * stride
                            sign(coder, i, bool(causal) and y == end - 1)
                            y += 1
                            i += stride
                    while y < end:
                        bottom = bool(causal) and y == top + 3
                        if step == 0:
                            if not sig[i] and (n := look(i, bottom)):
                                seen[i] = plane
                                if bit(contexts, zero[n]):
                                    sign(coder, i, bottom)
                        elif step == 1:
                            if sig[i] and seen[i] != plane:
                                c = 16 if refined[i] else 15 if look(i, bottom) else 14
                                mag[i] |= bit(contexts, c) << plane
                                refined[i] = 1
                                last[i] = plane
                        elif not sig[i] and seen[i] != plane and bit(contexts, zero[look(i, bottom)]):
                            sign(coder, i, bottom)
                        y += 1
                        i += stride
            if step == 2:
                if flags & _SEGMARK:
                    for _ in range(4):
                        bit(contexts, 18)
                plane -= 1
            if flags & _RESET:
                contexts = _fresh()
            index += 1
    m = np.array(mag, np.int64).reshape(h + 2, stride)[1:-1, 1:-1] * 2
    low = np.array(last, np.int64).reshape(h + 2, stride)[1:-1, 1:-1]
    return np.where((m > 0) & (low > 0), m | (1 << low), m), np.array(neg, np.int64).reshape(h + 2, stride)[1:-1, 1:-1]


def lift(a: np.ndarray, start: int, reversible: bool) -> np.ndarray:
    """One inverse step along the first axis, of interleaved samples that begin at ``start``."""
    n = len(a)
    if n == 1:
        return a if not start & 1 else (a >> 1 if reversible else a / 2)
    left = 4 + (start & 1)
    right = 4 + (n + left & 1)
    p = np.pad(a, [(left, right)] + [(0, 0)] * (a.ndim - 1), mode="reflect")
    e, o = p[0::2].copy(), p[1::2].copy()
    if reversible:
        e[1:] -= (o[:-1] + o[1:] + 2) >> 2
        o[:-1] += (e[:-1] + e[1:]) >> 1
    else:
        e *= 1.230174104914001
        o /= 1.230174104914001
        e[1:] -= 0.443506852043971 * (o[:-1] + o[1:])
        o[:-1] -= 0.882911075530934 * (e[:-1] + e[1:])
        e[1:] += 0.052980118572961 * (o[:-1] + o[1:])
        o[:-1] += 1.586134342059924 * (e[:-1] + e[1:])
    p[0::2], p[1::2] = e, o
    return p[left : left + n]


def merge(low: np.ndarray, bands: list[np.ndarray], box: tuple[int, int, int, int], reversible: bool) -> np.ndarray:
    """The next resolution of the one below and its HL, LH and HH bands."""
    x0, y0, x1, y1 = box
    a = np.zeros((y1 - y0, x1 - x0), np.int64 if reversible else np.float64)
    for k, b in enumerate([low, *bands]):
        a[(y0 & 1) ^ (k >> 1) :: 2, (x0 & 1) ^ (k & 1) :: 2] = b
    if not a.size:
        return a
    return lift(lift(a.T, x0, reversible).T, y0, reversible)


def _samples(part: list[Resolution], style: Style, depth: int) -> np.ndarray:
    made = None
    for r, res in enumerate(part):
        bands = []
        for band in res.bands:
            x0, y0, x1, y1 = band.box
            out = np.zeros((max(0, y1 - y0), max(0, x1 - x0)), np.int64 if style.reversible else np.float64)
            planes = style.guard + band.exponent - 1 + style.shift
            gain = depth + (0, 1, 1, 2)[band.kind]
            delta = 2.0 ** (gain - band.exponent) * (1 + band.mantissa / 2048)
            for rows, _, _ in band.precincts:
                for b in (b for row in rows for b in row if b.passes):
                    m, neg = coefficients(b, band.kind, style.flags, planes)
                    if style.shift:
                        m = np.where(m >= 2 << style.shift, m >> style.shift, m)
                    v = (m >> 1) if style.reversible else m * (delta / 2)
                    out[b.y0 - y0 : b.y1 - y0, b.x0 - x0 : b.x1 - x0] = np.where(neg == 1, -v, v)
            bands.append(out)
        made = bands[0] if r == 0 else merge(made, bands, res.box, style.reversible)
    return made


class Image:
    """The main header, and the tiles' parts."""

    def __init__(self, data: bytes):
        self.data = data
        self.size: tuple[int, ...] = ()
        self.parts: list[tuple[int, bool, int, int]] = []  # depth, signed, steps
        self.styles: dict[int | None, Style] = {}
        self.own: dict[int, dict[int | None, Style]] = {}
        self.changes: dict[int | None, list[tuple[int, ...]]] = {}
        self.bodies: dict[int, bytearray] = {}
        self._read()

    def _u(self, p: int, n: int) -> int:
        return int.from_bytes(self.data[p : p + n], "big")

    def _read(self) -> None:
        d, p, tile = self.data, 2, None
        end = len(d)
        while p + 2 <= len(d):
            marker = self._u(p, 2)
            if marker == 0xFFD9 or marker < 0xFF00:
                return
            length = self._u(p + 2, 2)
            if marker == 0xFF93:
                if tile is None:
                    raise PdfError("broken JPEG 2000 stream")
                self.bodies.setdefault(tile, bytearray()).extend(d[p + 2 : end])
                p, tile = end, None
                continue
            q = p + 4
            if marker == 0xFF90:
                tile, size = self._u(q, 2), self._u(q + 2, 4)
                end = len(d) if not size else min(len(d), p + size)
                if end < p + 12:
                    return
            elif marker == 0xFF51:
                self._sizes(q)
            elif marker in (0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF5E):
                self._style(marker, q, p + 2 + length, tile)
            elif marker == 0xFF5F:
                self._orders(q, p + 2 + length, tile)
            elif marker in (0xFF60, 0xFF61):
                raise PdfError("packed packet headers are not supported")
            p += 2 + length

    def _sizes(self, q: int) -> None:
        self.size = tuple(self._u(q + 2 + 4 * i, 4) for i in range(8))
        n = self._u(q + 34, 2)
        x1, y1, x0, y0, tw, th, tx, ty = self.size
        if not 0 < n <= 16_384 or not tw or not th or x1 <= x0 or y1 <= y0 or (x1 - x0) * (y1 - y0) > _MOST:
            raise PdfError("broken JPEG 2000 size")
        for i in range(n):
            v, dx, dy = self._u(q + 36 + 3 * i, 1), self._u(q + 37 + 3 * i, 1), self._u(q + 38 + 3 * i, 1)
            if not dx or not dy:
                raise PdfError("broken JPEG 2000 size")
            self.parts.append(((v & 127) + 1, bool(v & 128), dx, dy))

    def _of(self, tile: int | None, c: int | None) -> Style:
        """The style to be changed: of a tile or all, of a component or all."""
        table = self.styles if tile is None else self.own.setdefault(tile, {})
        if c not in table:
            table[c] = self.style(tile, c).copy() if (c is not None or tile is not None) else Style()
        return table[c]

    def style(self, tile: int | None, c: int | None) -> Style:
        for table, k in ((self.own.get(tile, {}), c), (self.own.get(tile, {}), None), (self.styles, c), (self.styles, None)):
            if k in table:
                return table[k]
        raise PdfError("JPEG 2000 stream without a coding style")

    def _style(self, marker: int, q: int, end: int, tile: int | None) -> None:
        c = None
        wide = 1 if len(self.parts) < 257 else 2
        if marker in (0xFF53, 0xFF5D, 0xFF5E):
            c = self._u(q, wide)
            q += wide
        if c is not None and None not in self.styles:
            self.styles[None] = Style()
        if marker in (0xFF52, 0xFF53):
            scod, targets = self._u(q, 1), [self._of(tile, c)]
            if c is None:  # components with a style of their own keep what theirs says of quantisation only
                targets += [s for k, s in (self.styles if tile is None else self.own[tile]).items() if k is not None]
            if marker == 0xFF52:
                for s in targets:
                    s.sop, s.eph, s.order, s.layers, s.transform = bool(scod & 2), bool(scod & 4), self._u(q + 1, 1), self._u(q + 2, 2), self._u(q + 4, 1)
                q += 4
            for s in targets[:1]:
                s.levels, s.block = self._u(q + 1, 1), (self._u(q + 2, 1) + 2, self._u(q + 3, 1) + 2)
                s.flags, s.reversible = self._u(q + 4, 1), self._u(q + 5, 1) == 1
                s.precincts = [(v & 15, v >> 4) for v in self.data[q + 6 : q + 7 + s.levels]] if scod & 1 else []
                if s.levels > 32 or s.block[0] > 10 or s.block[1] > 10 or sum(s.block) > 12:
                    raise PdfError("broken JPEG 2000 coding style")
        elif marker == 0xFF5E:
            self._of(tile, c).shift = self._u(q + 1, 1)
        else:
            s, v = self._of(tile, c), self._u(q, 1)
            s.quant, s.guard = v & 31, v >> 5
            raw = self.data[q + 1 : end]
            s.steps = [(x >> 3, 0) for x in raw] if not s.quant else [(x >> 11, x & 2047) for x in (raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2))]
            if not s.steps:
                raise PdfError("broken JPEG 2000 quantisation")

    def _orders(self, q: int, end: int, tile: int | None) -> None:
        wide = 1 if len(self.parts) < 257 else 2
        out = self.changes.setdefault(tile, [])
        while q + 5 + 2 * wide <= end:
            r0, c0, l1, r1 = self._u(q, 1), self._u(q + 1, wide), self._u(q + 1 + wide, 2), self._u(q + 3 + wide, 1)
            c1, order = self._u(q + 4 + wide, wide), self._u(q + 4 + 2 * wide, 1)
            out.append((r0, c0, l1, r1, c1 or 256, order))
            q += 5 + 2 * wide

    def tile(self, t: int) -> list[np.ndarray]:
        """The samples of a tile's components, each on its own grid."""
        x1, y1, x0, y0, tw, th, tx, ty = self.size
        across = _up(x1 - tx, tw)
        i, j = t % across, t // across
        box = max(tx + i * tw, x0), max(ty + j * th, y0), min(tx + (i + 1) * tw, x1), min(ty + (j + 1) * th, y1)
        if box[2] <= box[0] or box[3] <= box[1]:
            raise PdfError("tile out of range")
        styles = [self.style(t, c) for c in range(len(self.parts))]
        parts = [component(s, (_up(box[0], dx), _up(box[1], dy), _up(box[2], dx), _up(box[3], dy)), (dx, dy), box[:2]) for s, (_, _, dx, dy) in zip(styles, self.parts)]
        packets(bytes(self.bodies[t]), parts, styles, self.changes.get(t) or self.changes.get(None) or [])
        out = [_samples(p, s, depth) for p, s, (depth, *_) in zip(parts, styles, self.parts)]
        if styles[0].transform and len(out) >= 3 and len({a.shape for a in out[:3]}) == 1:
            y, b, r = out[:3]
            if styles[0].reversible:
                g = y - ((b + r) >> 2)
                out[:3] = [r + g, g, b + g]
            else:
                out[:3] = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
        return out

    def decode(self, most: int) -> np.ndarray:
        """(height, width, components), 8 bits each."""
        x1, y1, x0, y0, tw, th, tx, ty = self.size
        n = min(most, len(self.parts))
        out = np.zeros((y1 - y0, x1 - x0, n), np.uint8)
        across, bad = _up(x1 - tx, tw), 0
        for t in sorted(self.bodies):
            try:
                parts = self.tile(t)
            except (PdfError, IndexError, ValueError, KeyError, OverflowError, MemoryError):
                bad += 1  # the other tiles are still there
                continue
            i, j = t % across, t // across
            bx, by = max(tx + i * tw, x0), max(ty + j * th, y0)
            ex, ey = min(tx + (i + 1) * tw, x1), min(ty + (j + 1) * th, y1)
            for c in range(n):
                depth, signed, dx, dy = self.parts[c]
                a = parts[c] if parts[c].dtype == np.int64 else np.rint(parts[c])
                if not signed:
                    a = a + (1 << (depth - 1))
                else:
                    a = a + (1 << (depth - 1)) if depth > 1 else a
                a = np.clip(a, 0, (1 << depth) - 1).astype(np.int64)
                a = a >> (depth - 8) if depth > 8 else a * 255 // ((1 << depth) - 1) if depth < 8 else a
                if dx > 1 or dy > 1:
                    rows, columns = np.arange(by, ey) // dy - _up(by, dy), np.arange(bx, ex) // dx - _up(bx, dx)
                    a = a[np.clip(rows, 0, len(a) - 1)][:, np.clip(columns, 0, a.shape[1] - 1)]
                out[by - y0 : ey - y0, bx - x0 : ex - x0, c] = a
        if bad == len(self.bodies):
            raise PdfError("no JPEG 2000 tile can be decoded")
        return out


def boxes(data: bytes, p: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the boxes' contents."""
    end = len(data) if end is None else end
    while p + 8 <= end:
        n, kind, head = int.from_bytes(data[p : p + 4], "big"), data[p + 4 : p + 8], 8
        if n == 1:
            n, head = int.from_bytes(data[p + 8 : p + 16], "big"), 16
        last = end if n == 0 else min(end, p + n)
        if last < p + head:
            return
        yield kind, p + head, last
        p = last


def decode(data: bytes, most: int = 4) -> tuple[int, int, int, bytes]:
    """(width, height, components, samples); a palette's colours, where the boxes have one."""
    palette, mapping = None, []
    if data[:2] != b"\xff\x4f":
        stream = None
        for kind, a, b in boxes(data):
            if kind == b"jp2c":
                stream = data[a:b]
                break
            for inner, c, d in boxes(data, a, b) if kind == b"jp2h" else ():
                if inner == b"pclr" and d - c > 3:
                    n, k = int.from_bytes(data[c : c + 2], "big"), data[c + 2]
                    depths = data[c + 3 : c + 3 + k]
                    if all(v == 7 for v in depths) and d - c >= 3 + k + n * k:
                        palette = np.frombuffer(data[c + 3 + k : c + 3 + k + n * k], np.uint8).reshape(n, k)
                elif inner == b"cmap":
                    mapping = [(int.from_bytes(data[i : i + 2], "big"), data[i + 2], data[i + 3]) for i in range(c, d - 3, 4)]
        if stream is None:
            at = data.find(b"\xff\x4f\xff\x51")
            if at < 0:
                raise PdfError("no JPEG 2000 stream")
            stream = data[at:]
        data = stream
    image = Image(data)
    if not image.size or not image.bodies:
        raise PdfError("JPEG 2000 stream without tiles")
    a = image.decode(most)
    if palette is not None and mapping:
        depth = image.parts[0][0]
        index = a[..., 0].astype(np.int64)
        index = index * ((1 << depth) - 1) // 255 if depth < 8 else index
        a = np.stack([palette[np.minimum(index, len(palette) - 1), k] if kind == 1 and k < palette.shape[1] else a[..., min(c, a.shape[2] - 1)] for c, kind, k in mapping[:most]], 2)
    h, w, n = a.shape
    return w, h, n, np.ascontiguousarray(a).tobytes()


def plain(n: int, samples: bytes) -> tuple[int, bytes]:
    """(1 or 3, samples): gray or the first three components, where no colour space says more."""
    keep = 3 if n >= 3 else 1
    return keep, samples if keep == n else np.ascontiguousarray(np.frombuffer(samples, np.uint8).reshape(-1, n)[:, :keep]).tobytes()
