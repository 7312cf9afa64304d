"""Content streams: one pass gives text runs, image placements, rulings and font names."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from vellum.kernel.fonts import Font
from vellum.kernel.objects import END, Keyword, Name, Parser, Stream

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
DEPTH = 12
#: Points: how far from an axis a ruling may be, its least length, and the width of a rectangle that is one.
AXIS, RULE, THIN = 0.75, 24.0, 3.0
SPACE_KERN = 180
#: A string without escapes that is shown, as most are, and a step to the next line behind it.
_SHOWN = re.compile(rb"[\0\t\n\f\r ]*(?:\(([^\\()\r]*)\)|<((?:[0-9A-Fa-f]{2})*)>)[\0\t\n\f\r ]*Tj(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)([\0\t\n\f\r ]+T\*(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z))?")
_SHORT = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "IM": "ImageMask", "D": "Decode", "I": "Interpolate"}
_END_IMAGE = re.compile(rb"(?:(?<=[\0\t\n\f\r ])|\A)EI(?=[\0\t\n\f\r ]|\Z)")


def multiply(x: Matrix, y: Matrix) -> Matrix:
    """Rows times columns: first x, then y."""
    a, b, c, d, e, f = x
    g, h, i, j, k, m = y
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m


class Run(NamedTuple):
    text: str
    x: float
    y: float
    width: float
    font_size: float
    render_mode: int
    authoritative: int
    fallback: int
    unmapped: int
    space_width_em: float


#: What a run's row has: its number, its page, the run, whether it is a layer of recognized text.
RUN_ROW = ("run_id", "page", *Run._fields, "is_ocr_layer")


class Placement(NamedTuple):
    name: str
    stream: Stream
    matrix: Matrix


@dataclass
class Result:
    runs: list[Run] = field(default_factory=list)
    images: list[Placement] = field(default_factory=list)
    fonts: set[str] = field(default_factory=set)
    rulings: int = 0


class _State:
    __slots__ = ("ctm", "font", "size", "mode", "leading", "char", "word", "scale")

    def __init__(self, ctm: Matrix):
        self.ctm, self.font, self.size, self.mode, self.leading, self.char, self.word, self.scale = ctm, None, 0.0, 0, 0.0, 0.0, 0.0, 100.0

    def copy(self) -> _State:
        s = _State(self.ctm)
        for k in _State.__slots__:
            setattr(s, k, getattr(self, k))
        return s


def _number(x) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0


class Interpreter:
    def __init__(self, file, texts: bool = True):
        """``texts``: whether runs are wanted."""
        self.file, self.texts = file, texts
        self.fonts: dict[tuple[int, str], Font | None] = {}

    def run(self, content: bytes, resources: dict, base: Matrix = ONE) -> Result:
        out = Result()
        self._execute(content, resources, base, out, 0)
        return out

    def _font(self, name: str, resources: dict) -> Font | None:
        key = (id(resources), name)
        if key not in self.fonts:
            fonts = self.file.resolve(resources.get("Font"))
            d = self.file.resolve(fonts.get(name)) if isinstance(fonts, dict) else None
            self.fonts[key] = Font(d, self.file.resolve, self.file.decoded) if isinstance(d, dict) else None
        return self.fonts[key]

    def _execute(self, content: bytes, resources: dict, base: Matrix, out: Result, depth: int) -> None:
        if depth > DEPTH:
            return
        parser, state, stack, args = Parser(content), _State(base), [], []
        text = line = ONE
        path: list[tuple[float, float, float, float, bool]] = []
        x0 = y0 = cx = cy = 0.0

        def arg(k: int) -> float:
            return _number(args[-k]) if len(args) >= k else 0.0

        def point(x: float, y: float) -> tuple[float, float]:
            a, b, c, d, e, f = state.ctm
            return x * a + y * c + e, x * b + y * d + f

        def show(parts: list) -> None:
            nonlocal text
            if state.font is None or not self.texts:
                return
            words, advance, count, fallback, unmapped, font, scale = [], 0.0, 0, 0, 0, state.font, state.scale / 100
            for part in parts:
                if isinstance(part, bytes):
                    codes = font.codes(part)
                    t, f, u = font.text(codes)
                    words.append(t)
                    advance = font.advance(advance, codes, state.size, state.char, state.word, scale)
                    count, fallback, unmapped = count + len(codes), fallback + f, unmapped + u
                elif isinstance(part, (int, float)):
                    advance -= part / 1000 * state.size * scale
                    if part <= -SPACE_KERN:
                        words.append(" ")
            a, b, c, d, e, f = text
            after = _, _, _, _, p, q = a + 0.0 * c, b + 0.0 * d, 0.0 * a + c, 0.0 * b + d, advance * a + 0.0 * c + e, advance * b + 0.0 * d + f
            if shown := "".join(words):
                g, h, i, j, k, m = state.ctm
                x, y = e * g + f * i + k, e * h + f * j + m
                out.runs.append(Run(shown, x, y, math.hypot(p * g + q * i + k - x, p * h + q * j + m - y), state.size * math.hypot(c * g + d * i, c * h + d * j), state.mode, count - fallback - unmapped, fallback, unmapped, font.space))
            text = after

        def move(dx: float, dy: float) -> None:
            nonlocal text, line
            a, b, c, d, e, f = line
            text = line = a + 0.0 * c, b + 0.0 * d, 0.0 * a + c, 0.0 * b + d, dx * a + dy * c + e, dx * b + dy * d + f

        def paint(stroke: bool) -> None:
            for ax, ay, bx, by, thin in path:
                dx, dy = abs(bx - ax), abs(by - ay)
                if (dx < AXIS or dy < AXIS) and max(dx, dy) >= RULE and (stroke or thin):
                    out.rulings += 1
            path.clear()

        while True:
            if (m := _SHOWN.match(content, parser.pos, parser.end)) is not None:
                parser.pos = m.end()
                show([m[1] if m[2] is None else bytes.fromhex(m[2].decode())])
                if m[3] is not None:
                    move(0.0, -state.leading)
                args.clear()
                continue
            if (x := parser.next()) is END:
                break
            if not isinstance(x, Keyword):
                args.append(x)
                continue
            n = len(args)
            match str(x):
                case "]" | ">>" | ">":
                    continue
                case "q":
                    stack.append(state.copy())
                case "Q":
                    if stack:
                        state = stack.pop()
                case "cm":
                    if n >= 6:
                        state.ctm = multiply(tuple(_number(v) for v in args[-6:]), state.ctm)
                case "Do":
                    if n and isinstance(args[-1], Name):
                        self._object(str(args[-1]), resources, state.ctm, out, depth)
                case "BI":
                    self._inline(parser, state.ctm, out)
                case "BT":
                    text = line = ONE
                case "Td" | "TD":
                    if n >= 2:
                        if x == "TD":
                            state.leading = -arg(1)
                        move(arg(2), arg(1))
                case "Tm":
                    if n >= 6:
                        text = line = tuple(_number(v) for v in args[-6:])
                case "T*":
                    move(0.0, -state.leading)
                case "TL":
                    state.leading = arg(1) if n else state.leading
                case "Tc":
                    state.char = arg(1) if n else state.char
                case "Tw":
                    state.word = arg(1) if n else state.word
                case "Tz":
                    state.scale = arg(1) if n else state.scale
                case "Tr":
                    state.mode = int(arg(1)) if n else state.mode
                case "Tf":
                    if n >= 2:
                        state.size = arg(1)
                        if isinstance(args[-2], Name):
                            state.font = self._font(str(args[-2]), resources)
                            out.fonts.add(str(args[-2]))
                case "Tj" | "'" | '"':
                    if x != "Tj":
                        move(0.0, -state.leading)
                    if n and isinstance(args[-1], bytes):
                        show(args[-1:])
                case "TJ":
                    if n and isinstance(args[-1], list):
                        show(args[-1])
                case "m":
                    if n >= 2:
                        x0, y0 = cx, cy = point(arg(2), arg(1))
                case "l":
                    if n >= 2:
                        px, py = point(arg(2), arg(1))
                        path.append((cx, cy, px, py, False))
                        cx, cy = px, py
                case "re":
                    if n >= 4:
                        left, low, w, h = (_number(v) for v in args[-4:])
                        p = [point(left, low), point(left + w, low), point(left + w, low + h), point(left, low + h)]
                        thin = min(math.dist(p[0], p[1]), math.dist(p[0], p[3])) <= THIN
                        path += [(*a, *b, thin) for a, b in zip(p, p[1:] + p[:1])]
                        x0, y0 = cx, cy = p[0]
                case "c" | "v" | "y":
                    if n >= 2:
                        cx, cy = point(arg(2), arg(1))
                case "h":
                    path.append((cx, cy, x0, y0, False))
                    cx, cy = x0, y0
                case "S" | "s" | "B" | "B*" | "b" | "b*":
                    paint(True)
                case "f" | "F" | "f*":
                    paint(False)
                case "n":
                    path.clear()
            args.clear()

    def _object(self, name: str, resources: dict, ctm: Matrix, out: Result, depth: int) -> None:
        objects = self.file.resolve(resources.get("XObject"))
        s = self.file.resolve(objects.get(name)) if isinstance(objects, dict) else None
        if not isinstance(s, Stream):
            return
        kind = self.file.resolve(s.dict.get("Subtype"))
        if kind == "Image":
            out.images.append(Placement(name, s, ctm))
        elif kind == "Form":
            m = self.file.resolve(s.dict.get("Matrix"))
            own = tuple(_number(self.file.resolve(v)) for v in m[:6]) if isinstance(m, list) and len(m) >= 6 else ONE
            inner = self.file.resolve(s.dict.get("Resources"))
            self._execute(self.file.decoded(s), inner if isinstance(inner, dict) else resources, multiply(own, ctm), out, depth + 1)

    def _inline(self, parser: Parser, ctm: Matrix, out: Result) -> None:
        d: dict = {"Subtype": Name("Image")}
        while (k := parser.next()) is not END and k != "ID":
            if isinstance(k, Name):
                v = parser.next()
                if v is END or v == "ID":
                    break
                d[_SHORT.get(str(k), str(k))] = v
        if k is END:
            return
        m = _END_IMAGE.search(parser.data, min(parser.pos + 1, parser.end), parser.end)
        raw = parser.data[parser.pos + 1 : m.start() if m else parser.end]
        parser.pos = m.end() if m else parser.end
        out.images.append(Placement("inline", Stream(d, raw), ctm))
