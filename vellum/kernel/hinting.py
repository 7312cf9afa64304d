"""The TrueType instruction interpreter: points of simple glyphs fitted to the grid of one size, in 26.6 pixels.

A machine runs a font's program and the size's control value program once, then glyphs' instructions from the
state that these leave. Whatever goes wrong (a bad index, an endless loop, an unknown instruction) is a ``Fault``,
and the glyph is taken as scaled."""

from __future__ import annotations

import math
from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, field, replace

BUDGET, CALLS = 4_000_000, 128
ONE = 0x4000


class Fault(Exception):
    """A program that can't be run to its end."""


def _divided(a: int, b: int, c: int) -> int:
    """a * b / c to the nearest integer, halves away from zero."""
    if not c:
        return 0x7FFFFFFF if (a < 0) == (b < 0) else -0x7FFFFFFF
    sign = -1 if (a < 0) ^ (b < 0) ^ (c < 0) else 1
    a, b, c = abs(a), abs(b), abs(c)
    return sign * ((a * b + c // 2) // c)


def _signed(v: int) -> int:
    return (v + 0x80000000 & 0xFFFFFFFF) - 0x80000000


def _unit(x: float, y: float) -> tuple[int, int]:
    n = math.hypot(x, y)
    return (round(x / n * ONE), round(y / n * ONE)) if n else (ONE, 0)


@dataclass
class Zone:
    """Points as they are in the font, scaled, and now, with the axes along which each was moved."""

    font: list[list[int]]
    scaled: list[list[int]]
    now: list[list[int]]
    on: list[bool]
    ends: list[int] = field(default_factory=list)
    touched: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, points: list[tuple[int, int]], scale: Callable[[int], int], on: list[bool], ends: list[int]) -> Zone:
        scaled = [[scale(x), scale(y)] for x, y in points]
        return cls([list(p) for p in points], scaled, [list(p) for p in scaled], on, ends, [0] * len(points))


@dataclass
class State:
    """What SPVTL and the like set; a glyph's program begins with the control value program's."""

    projection: tuple[int, int] = (ONE, 0)
    dual: tuple[int, int] = (ONE, 0)
    freedom: tuple[int, int] = (ONE, 0)
    rp: tuple[int, ...] = (0, 0, 0)
    zp: tuple[int, ...] = (1, 1, 1)
    loop: int = 1
    least: int = 64
    cut_in: int = 68
    single: int = 0
    single_cut_in: int = 0
    flip: bool = True
    delta_base: int = 9
    delta_shift: int = 3
    control: int = 0
    rounding: tuple = ("grid",)


def _rounded(rule: tuple, v: int) -> int:
    """A distance rounded; what would change its sign is the least of its own sign."""
    kind, a = rule[0], abs(v)
    if kind == "off":
        return v
    if kind == "super":
        period, phase, threshold = rule[1:]
        a = (a - phase + threshold) // period * period + phase
        a = phase if a < 0 else a
    else:
        a = {"grid": a + 32 & -64, "half": (a & -64) + 32, "double": a + 16 & -32, "down": a & -64, "up": a + 63 & -64}[kind]
    return a if v >= 0 else -a


def _super(n: int, grid: float) -> tuple:
    period = int((0.5, 1, 2, 1)[n >> 6] * grid)
    return "super", period, (n >> 4 & 3) * period // 4, (n & 15) * period // 8 - period // 2 if n & 15 else period - 1


class Machine:
    """The interpreter of one font at one size. ``limits``: points of the twilight zone, storage, stack."""

    def __init__(self, units: int, ppem: int, cvt: list[int] = (), font: bytes = b"", size: bytes = b"", twilight: int = 0, storage: int = 0, stack: int = 4096):
        self.ppem, self.factor = ppem, _divided(ppem * 64, 0x10000, max(1, units))
        self.cvt = [self.scale(v) for v in cvt]
        self.storage, self.most = [0] * storage, stack + 64
        self.functions: dict[int, tuple[bytes, int]] = {}
        self.own: dict[int, tuple[bytes, int]] = {}
        n = twilight + 4
        self.twilight = Zone.of([(0, 0)] * n, int, [True] * n, [])
        self.glyph = Zone([], [], [], [])
        self.state, self.stack, self.left = State(), [], BUDGET
        self.in_size = False
        if font:
            self.run(font)
        self.state, self.in_size = State(), True
        if size:
            self.run(size)
        self.in_size = False
        fresh = State()
        keep = {k: getattr(fresh, k) for k in ("projection", "dual", "freedom", "rp", "zp", "loop")}
        self.start = replace(fresh, control=self.state.control) if self.state.control & 2 else replace(self.state, **keep)
        self.kept = deepcopy((self.cvt, self.storage, self.twilight))

    def scale(self, v: int) -> int:
        return _divided(v, self.factor, 0x10000)

    def fit(self, points: list[tuple[int, int]], on: list[bool], ends: list[int], bearing: int, advance: int, program: bytes) -> tuple[list[list[int]], list[bool]]:
        """The points of a glyph after its instructions, and which lie on the curve. Four more stand for its
        origin and advance."""
        n = len(points)
        left = min((x for x, _ in points), default=0) - bearing
        self.glyph = Zone.of([*points, (left, 0), (left + advance, 0), (0, 0), (0, 0)], self.scale, [*on, True, True, True, True], ends)
        self.state, self.stack, self.left = replace(self.start), [], BUDGET
        self.cvt, self.storage, self.twilight = deepcopy(self.kept)  # no glyph sees what another one left
        if program and not self.state.control & 1:
            self.run(program)
        return self.glyph.now[:n], self.glyph.on[:n]

    def run(self, code: bytes) -> None:
        self.stack = []
        try:
            self._run(code, 0, 0)
        except (IndexError, KeyError, ValueError, OverflowError, RecursionError) as e:
            raise Fault(f"{type(e).__name__}: {e}") from e

    # Points, distances and moves.

    def zone(self, i: int) -> Zone:
        return self.glyph if self.state.zp[i] else self.twilight

    def point(self, zone: Zone, i: int) -> int:
        if not 0 <= i < len(zone.now):
            raise Fault(f"no point {i}")
        return i

    @staticmethod
    def along(vector: tuple[int, int], a: list[int], b: list[int] | tuple[int, int] = (0, 0)) -> int:
        return _divided((a[0] - b[0]) * vector[0] + (a[1] - b[1]) * vector[1], 1, ONE)

    def project(self, a: list[int], b: list[int] | tuple[int, int] = (0, 0)) -> int:
        return self.along(self.state.projection, a, b)

    def dual(self, a: list[int], b: list[int] | tuple[int, int] = (0, 0)) -> int:
        return self.along(self.state.dual, a, b)

    def shift(self, distance: int) -> tuple[int, int]:
        """The move along the freedom vector that adds a distance along the projection vector."""
        (fx, fy), (px, py) = self.state.freedom, self.state.projection
        dot = fx * px + fy * py
        if abs(dot) < ONE * ONE // 16:
            dot = ONE * ONE
        return _divided(distance, fx * ONE, dot), _divided(distance, fy * ONE, dot)

    def move(self, zone: Zone, i: int, distance: int) -> None:
        self.add(zone, i, *self.shift(distance))

    def add(self, zone: Zone, i: int, dx: int, dy: int, touch: bool = True) -> None:
        fx, fy = self.state.freedom
        p = zone.now[self.point(zone, i)]
        if fx:
            p[0] += dx
            zone.touched[i] |= touch
        if fy:
            p[1] += dy
            zone.touched[i] |= 2 * touch

    def round(self, v: int) -> int:
        return _rounded(self.state.rounding, v)

    def pop(self) -> int:
        if not self.stack:
            raise Fault("empty stack")
        return self.stack.pop()

    def push(self, *values: int) -> None:
        self.stack += map(_signed, values)
        if len(self.stack) > self.most:
            raise Fault("full stack")

    def looped(self):
        """The points of an instruction that the loop variable repeats."""
        n, self.state.loop = self.state.loop, 1
        for _ in range(n):
            yield self.pop()

    def original(self, i: int, a: int, j: int, b: int) -> int:
        """The distance of point a in zone i from b in zone j as the font has them."""
        x, y = self.zone(i), self.zone(j)
        self.point(x, a), self.point(y, b)
        if x is self.twilight or y is self.twilight:
            return self.dual(x.scaled[a], y.scaled[b])
        return self.scale(self.dual(x.font[a], y.font[b]))

    # Control flow.

    def skip(self, code: bytes, p: int) -> int:
        """Where the instruction after the one at p begins."""
        op = code[p]
        if op in (0x40, 0x41):
            return p + 2 + code[p + 1] * (op - 0x3F)
        if 0xB0 <= op <= 0xBF:
            return p + 1 + (op % 8 + 1) * (1 if op < 0xB8 else 2)
        return p + 1

    def over(self, code: bytes, p: int, stops: tuple[int, ...]) -> int:
        """Behind the IF's own ELSE or EIF."""
        depth = 0
        while True:
            op, p = code[p], self.skip(code, p)
            if not depth and op in stops:
                return p
            depth += (op == 0x58) - (op == 0x59)

    def define(self, code: bytes, p: int, to: dict[int, tuple[bytes, int]]) -> int:
        to[self.pop()] = (code, p)
        while code[p] != 0x2D:
            p = self.skip(code, p)
        return p + 1

    def call(self, to: tuple[bytes, int], depth: int) -> None:
        if depth >= CALLS:
            raise Fault("too many calls")
        self._run(*to, depth + 1)

    def _run(self, code: bytes, p: int, depth: int) -> None:
        while p < len(code):
            self.left -= 1
            if self.left < 0:
                raise Fault("too many instructions")
            at, op = p, code[p]
            p = self.skip(code, p)
            if op in (0x40, 0x41) or 0xB0 <= op <= 0xBF:
                first = at + (2 if op < 0x42 else 1)
                if p > len(code):
                    raise Fault("cut short")
                if op == 0x40 or 0xB0 <= op < 0xB8:
                    self.push(*code[first:p])
                else:
                    self.push(*(int.from_bytes(code[i : i + 2], "big", signed=True) for i in range(first, p, 2)))
            elif op == 0x2D:  # ENDF
                return
            elif op == 0x58:  # IF
                if not self.pop():
                    p = self.over(code, p, (0x1B, 0x59))
            elif op == 0x1B:  # ELSE, after a branch that was taken
                p = self.over(code, p, (0x59,))
            elif op in (0x1C, 0x78, 0x79):  # JMPR, JROT, JROF
                yes = op == 0x1C or bool(self.pop()) == (op == 0x78)
                offset = self.pop()
                if yes:
                    if not offset or at + offset < 0:
                        raise Fault("jump")
                    p = at + offset
            elif op == 0x2B:  # CALL
                self.call(self.functions[self.pop()], depth)
            elif op == 0x2A:  # LOOPCALL
                f = self.functions[self.pop()]
                for _ in range(self.pop()):
                    self.call(f, depth)
            elif op == 0x2C:
                p = self.define(code, p, self.functions)
            elif op == 0x89:
                p = self.define(code, p, self.own)
            elif op >= 0xC0:
                (self._mdrp if op < 0xE0 else self._mirp)(op)
            elif (f := _OPS.get(op)) is not None:
                f(self, op)
            elif op in self.own:
                self.call(self.own[op], depth)
            else:
                raise Fault(f"instruction {op:02x}")

    # Vectors.

    def _axis(self, op: int) -> None:
        v, s = ((ONE, 0) if op & 1 else (0, ONE)), self.state
        if op < 4:
            s.projection = s.dual = v
        if op < 2 or op > 3:
            s.freedom = v

    def _between(self, a: list[int], b: list[int], op: int) -> tuple[int, int]:
        x, y = a[0] - b[0], a[1] - b[1]
        if not x and not y:
            return ONE, 0
        return _unit(-y, x) if op & 1 else _unit(x, y)

    def _line(self, op: int) -> None:
        i, j = self.pop(), self.pop()
        x, y = self.zone(2), self.zone(1)
        self.point(x, i), self.point(y, j)
        v, s = self._between(y.now[j], x.now[i], op), self.state
        if op < 8:
            s.projection = s.dual = v
        elif op < 0x10:
            s.freedom = v
        else:
            s.projection, s.dual = v, self._between(y.scaled[j], x.scaled[i], op)

    def _stack_vector(self, op: int) -> None:
        y, x = self.pop(), self.pop()
        v, s = _unit(*((c + 0x8000 & 0xFFFF) - 0x8000 for c in (x, y))), self.state
        if op == 0x0A:
            s.projection = s.dual = v
        else:
            s.freedom = v

    # Moves of points.

    def _isect(self, op: int) -> None:
        b1, b0, a1, a0, i = (self.pop() for _ in range(5))
        za, zb, z = self.zone(1), self.zone(0), self.zone(2)
        p, q = (za.now[self.point(za, k)] for k in (a0, a1))
        r, s = (zb.now[self.point(zb, k)] for k in (b0, b1))
        ax, ay, bx, by = q[0] - p[0], q[1] - p[1], s[0] - r[0], s[1] - r[1]
        cross = ax * by - ay * bx
        t = z.now[self.point(z, i)]
        if 19 * abs(cross) > abs(ax * bx + ay * by):
            k = (r[0] - p[0]) * by - (r[1] - p[1]) * bx
            t[:] = [p[0] + _divided(k, ax, cross), p[1] + _divided(k, ay, cross)]
        else:
            t[:] = [sum(c) // 4 for c in zip(p, q, r, s)]
        z.touched[i] |= 3

    def _alignpts(self, op: int) -> None:
        j, i = self.pop(), self.pop()
        a, b = self.zone(1), self.zone(0)
        d = self.project(b.now[self.point(b, j)], a.now[self.point(a, i)])
        self.move(a, i, int(d / 2))
        self.move(b, j, -int(d / 2))

    def _mdap(self, op: int) -> None:
        i, z, s = self.pop(), self.zone(0), self.state
        d = self.project(z.now[self.point(z, i)])
        self.move(z, i, self.round(d) - d if op & 1 else 0)
        s.rp = (i, i, s.rp[2])

    def _miap(self, op: int) -> None:
        d, i, z, s = self.cvt[self.index(self.cvt)], self.pop(), self.zone(0), self.state
        self.point(z, i)
        if z is self.twilight:
            z.scaled[i] = [_divided(d, c, ONE) for c in s.freedom]
            z.now[i] = list(z.scaled[i])
        own = self.project(z.now[i])
        if op & 1:
            d = self.round(own if abs(d - own) > s.cut_in else d)
        self.move(z, i, d - own)
        s.rp = (i, i, s.rp[2])

    def _whole(self, d: int, of: int, op: int) -> int:
        """The distance with the least one's bound, with the sign of another."""
        if op & 8:
            return max(d, self.state.least) if of >= 0 else min(d, -self.state.least)
        return d

    def _single(self, d: int) -> int:
        s = self.state
        return (s.single if d >= 0 else -s.single) if abs(abs(d) - s.single) < s.single_cut_in else d

    def _mdrp(self, op: int) -> None:
        i, s = self.pop(), self.state
        a, b = self.zone(1), self.zone(0)
        org = self._single(self.original(1, i, 0, s.rp[0]))
        d = self._whole(self.round(org) if op & 4 else org, org, op)
        self.move(a, i, d - self.project(a.now[i], b.now[s.rp[0]]))
        s.rp = (i if op & 16 else s.rp[0], s.rp[0], i)

    def _mirp(self, op: int) -> None:
        d, i, s = self._single(self.cvt[self.index(self.cvt)]), self.pop(), self.state
        a, b = self.zone(1), self.zone(0)
        base = self.point(b, s.rp[0])
        self.point(a, i)
        if a is self.twilight:
            a.scaled[i] = [o + _divided(d, c, ONE) for o, c in zip(b.scaled[base], s.freedom)]
            a.now[i] = list(a.scaled[i])
        org, own = self.dual(a.scaled[i], b.scaled[base]), self.project(a.now[i], b.now[base])
        if s.flip and (org < 0) != (d < 0):
            d = -d
        if op & 4:
            d = self.round(org if s.zp[0] == s.zp[1] and abs(d - org) > s.cut_in else d)
        self.move(a, i, self._whole(d, org, op) - own)
        s.rp = (i if op & 16 else s.rp[0], s.rp[0], i)

    def _msirp(self, op: int) -> None:
        d, i, s = self.pop(), self.pop(), self.state
        a, b = self.zone(1), self.zone(0)
        base = self.point(b, s.rp[0])
        self.point(a, i)
        if a is self.twilight:
            a.scaled[i] = [o + c for o, c in zip(b.scaled[base], self.shift(d))]
            a.now[i] = list(a.scaled[i])
        self.move(a, i, d - self.project(a.now[i], b.now[base]))
        s.rp = (i if op & 1 else s.rp[0], s.rp[0], i)

    def _alignrp(self, op: int) -> None:
        a, b = self.zone(1), self.zone(0)
        base = b.now[self.point(b, self.state.rp[0])]
        for i in self.looped():
            self.move(a, i, -self.project(a.now[self.point(a, i)], base))

    def _ip(self, op: int) -> None:
        s = self.state
        z, a, b = self.zone(2), self.zone(0), self.zone(1)
        base = a.now[self.point(a, s.rp[1])]
        some = 0 in s.zp
        at = (lambda i, p: self.dual(self.zone(i).scaled[p], a.scaled[s.rp[1]])) if some else (lambda i, p: self.dual(self.zone(i).font[p], a.font[s.rp[1]]))
        old, new = at(1, self.point(b, s.rp[2])), self.project(b.now[s.rp[2]], base)
        for i in self.looped():
            d = at(2, self.point(z, i))
            to = _divided(d, new, old) if old else (d if some else self.scale(d))
            self.move(z, i, to - self.project(z.now[i], base))

    def _moved(self, op: int) -> tuple[Zone, int, tuple[int, int]]:
        """The reference point of a shift, and by how much it was moved."""
        z, i = (self.zone(0), self.state.rp[1]) if op & 1 else (self.zone(1), self.state.rp[2])
        return z, i, self.shift(self.project(z.now[self.point(z, i)], z.scaled[i]))

    def _shp(self, op: int) -> None:
        _, _, d = self._moved(op)
        for i in self.looped():
            self.add(self.zone(2), i, *d)

    def _shc(self, op: int) -> None:
        of, ref, d = self._moved(op)
        k, z = self.pop(), self.zone(2)
        first = z.ends[k - 1] + 1 if k else 0
        for i in range(first, z.ends[k] + 1 if z.ends else len(z.now)):
            if z is not of or i != ref:
                self.add(z, i, *d)

    def _shz(self, op: int) -> None:
        of, ref, d = self._moved(op)
        if self.pop() not in (0, 1):
            raise Fault("zone")
        z = self.zone(2)
        for i in range(z.ends[-1] + 1 if z.ends else len(z.now)):
            if z is not of or i != ref:
                self.add(z, i, *d, touch=False)

    def _shpix(self, op: int) -> None:
        d = self.pop()
        d = tuple(_divided(d, c, ONE) for c in self.state.freedom)
        for i in self.looped():
            self.add(self.zone(2), i, *d)

    def _iup(self, op: int) -> None:
        """Points between touched ones of their contour follow these."""
        z, k = self.glyph, 0 if op & 1 else 1
        first = 0
        for end in z.ends:
            held = [i for i in range(first, end + 1) if z.touched[i] & (1 << k)]
            for a, b in zip(held, held[1:] + held[:1]):
                between = [*range(a + 1, b)] if b > a else [*range(a + 1, end + 1), *range(first, b)]
                for i in between:
                    z.now[i][k] = self._interpolated(z, i, *((a, b) if z.font[a][k] <= z.font[b][k] else (b, a)), k)
            first = end + 1

    @staticmethod
    def _interpolated(z: Zone, i: int, a: int, b: int, k: int) -> int:
        v, low, high = z.font[i][k], z.font[a][k], z.font[b][k]
        if v <= low or low == high:
            return z.scaled[i][k] + z.now[a][k] - z.scaled[a][k]
        if v >= high:
            return z.scaled[i][k] + z.now[b][k] - z.scaled[b][k]
        return z.now[a][k] + _divided(v - low, z.now[b][k] - z.now[a][k], high - low)

    def _deltas(self, op: int) -> None:
        s = self.state
        points = op in (0x5D, 0x71, 0x72)
        step = {0x5D: 0, 0x71: 16, 0x72: 32, 0x73: 0, 0x74: 16, 0x75: 32}[op]
        for _ in range(self.pop()):
            i, arg = self.pop(), self.pop()
            if (arg >> 4 & 15) + step + s.delta_base == self.ppem:
                d = (arg & 15) - 8
                d = (d + (d >= 0)) * 64 >> s.delta_shift
                if points:
                    if 0 <= i < len(self.zone(0).now):
                        self.move(self.zone(0), i, d)
                elif 0 <= i < len(self.cvt):
                    self.cvt[i] += d

    def _flips(self, op: int) -> None:
        if op == 0x80:
            for i in self.looped():
                self.glyph.on[i] = not self.glyph.on[self.point(self.glyph, i)]
        else:
            high, low = self.pop(), self.pop()
            for i in range(self.point(self.glyph, low), self.point(self.glyph, high) + 1):
                self.glyph.on[i] = op == 0x81

    # Values.

    def index(self, values: list[int]) -> int:
        i = self.pop()
        if not 0 <= i < len(values):
            raise Fault(f"no value {i}")
        return i

    def _gc(self, op: int) -> None:
        z = self.zone(2)
        i = self.point(z, self.pop())
        self.push(self.dual(z.scaled[i]) if op & 1 else self.project(z.now[i]))

    def _md(self, op: int) -> None:
        i, j = self.pop(), self.pop()
        a, b = self.zone(0), self.zone(1)
        self.point(b, i), self.point(a, j)
        self.push(self.project(a.now[j], b.now[i]) if op & 1 else self.original(0, j, 1, i))

    def _scfs(self, op: int) -> None:
        v, i, z = self.pop(), self.pop(), self.zone(2)
        self.move(z, i, v - self.project(z.now[self.point(z, i)]))
        if z is self.twilight:
            z.scaled[i] = list(z.now[i])

    def _utp(self, op: int) -> None:
        z, (fx, fy) = self.zone(0), self.state.freedom
        z.touched[self.point(z, self.pop())] &= ~((1 if fx else 0) | (2 if fy else 0))

    def _store(self, op: int) -> None:
        v = self.pop()
        if op == 0x42:
            self.storage[self.index(self.storage)] = v
        else:
            self.cvt[self.index(self.cvt)] = v if op == 0x44 else self.scale(v)

    def _reference(self, op: int) -> None:
        s, v = self.state, self.pop()
        if op < 0x13:
            s.rp = tuple(v if k == op - 0x10 else x for k, x in enumerate(s.rp))
        elif v not in (0, 1):
            raise Fault("zone")
        else:
            s.zp = (v, v, v) if op == 0x16 else tuple(v if k == op - 0x13 else x for k, x in enumerate(s.zp))

    def _control(self, op: int) -> None:
        which, v = self.pop(), self.pop()
        if self.in_size and which in (1, 2):
            self.state.control = self.state.control | which if v else self.state.control & ~which

    def _take(self, op: int) -> None:
        """CINDEX copies, MINDEX moves to the top."""
        k = self.pop()
        if not 0 < k <= len(self.stack):
            raise Fault("index into the stack")
        self.push(self.stack[-k] if op == 0x25 else self.stack.pop(-k))

    def _two(self, f: Callable[[int, int], int]) -> None:
        b, a = self.pop(), self.pop()
        self.push(f(a, b))

    def set(self, **values) -> None:
        for k, v in values.items():
            setattr(self.state, k, v)

    def _loop(self, op: int) -> None:
        n = self.pop()
        if n < 0:
            raise Fault("loop")
        self.state.loop = min(n, 0xFFFF)

    def _info(self, op: int) -> None:
        """A rasterizer of version 40 with shades of grey."""
        what = self.pop()
        self.push((40 if what & 1 else 0) | (0x1000 if what & 0x20 else 0))


def _quotient(a: int, b: int) -> int:
    if not b:
        raise Fault("division by zero")
    q = abs(a) * 64 // abs(b)
    return q if (a < 0) == (b < 0) else -q


_TWO = {
    0x50: lambda a, b: a < b, 0x51: lambda a, b: a <= b, 0x52: lambda a, b: a > b, 0x53: lambda a, b: a >= b, 0x54: lambda a, b: a == b, 0x55: lambda a, b: a != b, 0x5A: lambda a, b: bool(a and b),
    0x5B: lambda a, b: bool(a or b), 0x60: lambda a, b: a + b, 0x61: lambda a, b: a - b, 0x62: _quotient, 0x63: lambda a, b: _divided(a, b, 64), 0x8B: max, 0x8C: min,
}
_ONE = {
    0x5C: lambda m, a: not a, 0x64: lambda m, a: abs(a), 0x65: lambda m, a: -a, 0x66: lambda m, a: a & -64, 0x67: lambda m, a: a + 63 & -64, 0x56: lambda m, a: m.round(a) & 127 == 64, 0x57: lambda m, a: m.round(a) & 127 == 0,
    **{op: lambda m, a: m.round(a) for op in range(0x68, 0x6C)}, **{op: lambda m, a: a for op in range(0x6C, 0x70)},
}
_ROUND = {0x18: "grid", 0x19: "half", 0x3D: "double", 0x7A: "off", 0x7C: "up", 0x7D: "down"}
_SET = {0x1A: "least", 0x1D: "cut_in", 0x1E: "single_cut_in", 0x5E: "delta_base", 0x5F: "delta_shift"}
M = Machine
_OPS: dict[int, Callable[[Machine, int], object]] = {
    **{op: M._axis for op in range(0x06)}, **{op: M._line for op in (0x06, 0x07, 0x08, 0x09, 0x86, 0x87)}, 0x0A: M._stack_vector, 0x0B: M._stack_vector, 0x0C: lambda m, op: m.push(*m.state.projection),
    0x0D: lambda m, op: m.push(*m.state.freedom), 0x0E: lambda m, op: m.set(freedom=m.state.projection), 0x0F: M._isect, **{op: M._reference for op in range(0x10, 0x17)}, 0x17: M._loop,
    0x1F: lambda m, op: m.set(single=m.scale(m.pop())), 0x20: lambda m, op: m.push(*[m.pop()] * 2), 0x21: lambda m, op: m.pop(), 0x22: lambda m, op: m.stack.clear(), 0x23: lambda m, op: m.push(m.pop(), m.pop()),
    0x24: lambda m, op: m.push(len(m.stack)), 0x25: M._take, 0x26: M._take, 0x27: M._alignpts, 0x29: M._utp, 0x2E: M._mdap, 0x2F: M._mdap, 0x30: M._iup, 0x31: M._iup, 0x32: M._shp, 0x33: M._shp,
    0x34: M._shc, 0x35: M._shc, 0x36: M._shz, 0x37: M._shz, 0x38: M._shpix, 0x39: M._ip, 0x3A: M._msirp, 0x3B: M._msirp, 0x3C: M._alignrp, 0x3E: M._miap, 0x3F: M._miap, 0x42: M._store, 0x44: M._store, 0x70: M._store,
    0x43: lambda m, op: m.push(m.storage[m.index(m.storage)]), 0x45: lambda m, op: m.push(m.cvt[m.index(m.cvt)]), 0x46: M._gc, 0x47: M._gc, 0x48: M._scfs, 0x49: M._md, 0x4A: M._md,
    0x4B: lambda m, op: m.push(m.ppem), 0x4C: lambda m, op: m.push(m.ppem), 0x4D: lambda m, op: m.set(flip=True), 0x4E: lambda m, op: m.set(flip=False), 0x59: lambda m, op: None,
    **{op: M._deltas for op in (0x5D, 0x71, 0x72, 0x73, 0x74, 0x75)}, 0x76: lambda m, op: m.set(rounding=_super(m.pop() & 255, 64)), 0x77: lambda m, op: m.set(rounding=_super(m.pop() & 255, 64 * math.sqrt(0.5))),
    **{op: lambda m, op: m.pop() for op in (0x4F, 0x7E, 0x7F, 0x85, 0x8D)}, 0x80: M._flips, 0x81: M._flips, 0x82: M._flips, 0x88: M._info, 0x8A: lambda m, op: m.push(*(lambda c, b, a: (b, c, a))(m.pop(), m.pop(), m.pop())), 0x8E: M._control,
    **{op: lambda m, op: m._two(_TWO[op]) for op in _TWO}, **{op: lambda m, op: m.push(int(_ONE[op](m, m.pop()))) for op in _ONE},
    **{op: lambda m, op: m.set(rounding=(_ROUND[op],)) for op in _ROUND}, **{op: lambda m, op: m.set(**{_SET[op]: m.pop()}) for op in _SET},
}
