"""PDF functions on arrays: sampled, exponential, stitching and calculator. Inputs are n x m, outputs n x k."""

from __future__ import annotations

import math

import numpy as np

from vellum.kernel.objects import END, Keyword, Parser, PdfError, Stream

STEPS = 100_000


class Function:
    def __init__(self, domain: list[float], range_: list[float] | None):
        self.domain, self.range = np.array(domain, float).reshape(-1, 2), None if range_ is None else np.array(range_, float).reshape(-1, 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        n = min(x.shape[1], len(self.domain))
        x = np.clip(x[:, :n], self.domain[:n, 0], self.domain[:n, 1])
        y = self.values(x)
        if self.range is not None:
            k = min(y.shape[1], len(self.range))
            y = np.clip(y[:, :k], self.range[:k, 0], self.range[:k, 1])
        return y

    def values(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Several(Function):
    """One function for each output."""

    def __init__(self, parts: list[Function]):
        super().__init__([0.0, 1.0], None)
        self.parts = parts

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([p(x) for p in self.parts], 1)


class Exponential(Function):
    def __init__(self, domain, range_, c0, c1, n):
        super().__init__(domain, range_)
        self.c0, self.c1, self.n = np.array(c0, float), np.array(c1, float), n

    def values(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.c0 + np.nan_to_num(x[:, :1] ** self.n) * (self.c1 - self.c0)


class Stitching(Function):
    def __init__(self, domain, range_, parts, bounds, encode):
        super().__init__(domain, range_)
        self.parts, self.bounds, self.encode = parts, np.array(bounds, float), np.array(encode, float).reshape(-1, 2)

    def values(self, x: np.ndarray) -> np.ndarray:
        v = x[:, 0]
        which = np.minimum(np.searchsorted(self.bounds, v, "right"), len(self.parts) - 1)
        edges = np.concatenate([self.domain[0, :1], self.bounds, self.domain[0, 1:]])
        out = None
        for i, f in enumerate(self.parts):
            own = which == i
            low, high = edges[i], edges[i + 1]
            e0, e1 = self.encode[i]
            t = e0 + (v[own] - low) * ((e1 - e0) / (high - low) if high != low else 0.0)
            y = f(t[:, None])
            if out is None:
                out = np.zeros((len(x), y.shape[1]))
            out[own] = y
        return out


class Sampled(Function):
    """Multilinear between samples."""

    def __init__(self, domain, range_, size, bits, encode, decode, data):
        super().__init__(domain, range_)
        self.size, k = np.array(size, int), len(range_) // 2
        total = int(np.prod(self.size)) * k
        if bits == 8:
            raw = np.frombuffer(data[:total], np.uint8).astype(float)
        elif bits in (16, 32):
            raw = np.frombuffer(data[: total * bits // 8 // (bits // 8) * (bits // 8)], f">u{bits // 8}").astype(float)
        else:
            b = np.unpackbits(np.frombuffer(data, np.uint8))
            n = min(total, len(b) // bits)
            raw = (b[: n * bits].reshape(n, bits) * (2.0 ** np.arange(bits - 1, -1, -1))).sum(1)
        raw = np.concatenate([raw, np.zeros(max(0, total - len(raw)))])
        d = np.array(decode, float).reshape(-1, 2)
        self.samples = d[:, 0] + raw.reshape(-1, k) / (2.0**bits - 1) * (d[:, 1] - d[:, 0])
        self.encode = np.array(encode, float).reshape(-1, 2)
        self.stride = np.concatenate([[1], np.cumprod(self.size)[:-1]])

    def values(self, x: np.ndarray) -> np.ndarray:
        m = x.shape[1]
        span = self.domain[:m, 1] - self.domain[:m, 0]
        t = self.encode[:m, 0] + (x - self.domain[:m, 0]) * np.where(span == 0, 0.0, (self.encode[:m, 1] - self.encode[:m, 0]) / np.where(span == 0, 1, span))
        t = np.clip(t, 0, self.size[:m] - 1)
        low = np.minimum(t.astype(int), np.maximum(self.size[:m] - 2, 0))
        part = t - low
        out = np.zeros((len(x), self.samples.shape[1]))
        for corner in range(1 << m):
            bit = np.array([corner >> i & 1 for i in range(m)])
            at = np.minimum(low + bit, self.size[:m] - 1)
            out += np.prod(np.where(bit, part, 1 - part), 1)[:, None] * self.samples[(at * self.stride[:m]).sum(1)]
        return out


class Calculator(Function):
    """PostScript calculator, on whole arrays where no branch depends on a value, else row by row."""

    def __init__(self, domain, range_, code: bytes):
        super().__init__(domain, range_)
        p = Parser(code)
        self.program = self._block(p) if p.next() == "{" else []

    def _block(self, p: Parser) -> list:
        out: list = []
        while (x := p.next()) is not END and x != "}":
            out.append(self._block(p) if x == "{" else x)
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        k = len(self.range) if self.range is not None else 1
        known: dict[tuple, list[float]] = {}
        out = np.zeros((len(x), k))
        for i, row in enumerate(x.tolist()):
            key = tuple(row)
            if key not in known:
                stack: list = list(row)
                self.left = STEPS
                try:
                    self._run(self.program, stack)
                except (IndexError, OverflowError, ValueError, TypeError):
                    pass
                y = [float(v) for v in stack[-k:]]
                known[key] = [0.0] * (k - len(y)) + y
            out[i] = known[key]
        return out

    def _run(self, program: list, s: list) -> None:
        for i, x in enumerate(program):
            self.left -= 1
            if self.left < 0:
                return
            if not isinstance(x, Keyword):
                if not isinstance(x, list):
                    s.append(x)
                elif i + 1 < len(program) and program[i + 1] == "if":
                    if s.pop():
                        self._run(x, s)
                elif i + 2 < len(program) and program[i + 2] == "ifelse":
                    self._run(x if s.pop() else program[i + 1], s)
                continue
            if (f := _ONE.get(str(x))) is not None:
                s.append(f(s.pop()))
            elif (g := _TWO.get(str(x))) is not None:
                b, a = s.pop(), s.pop()
                s.append(g(a, b))
            elif x == "pop":
                s.pop()
            elif x == "exch":
                s[-1], s[-2] = s[-2], s[-1]
            elif x == "dup":
                s.append(s[-1])
            elif x == "copy":
                n = int(s.pop())
                s += s[-n:] if 0 < n <= len(s) else []
            elif x == "index":
                s.append(s[-1 - int(s.pop())])
            elif x == "roll":
                j, n = int(s.pop()), int(s.pop())
                if 0 < n <= len(s):
                    part = s[-n:]
                    s[-n:] = part[-(j % n) :] + part[: -(j % n)] if j % n else part


def _bits(a, b, f):
    return f(bool(a), bool(b)) if isinstance(a, bool) else f(int(a), int(b))


_ONE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "sqrt": lambda a: math.sqrt(a) if a > 0 else 0.0,
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0,
    "cvi": math.trunc, "cvr": float, "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}
_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0, "idiv": lambda a, b: math.trunc(a / b) if b else 0, "mod": lambda a, b: math.fmod(a, b) if b else 0,
    "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "exp": lambda a, b: a**b if a >= 0 or b == int(b) else 0.0, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": lambda a, b: _bits(a, b, lambda x, y: x & y), "or": lambda a, b: _bits(a, b, lambda x, y: x | y), "xor": lambda a, b: _bits(a, b, lambda x, y: x ^ y),
    "bitshift": lambda a, b: int(a) << int(b) if b >= 0 else int(a) >> -int(b),
}


def parse(file, x, depth: int = 0) -> Function:
    x = file.resolve(x)
    if depth > 8:
        raise PdfError("functions nested too deep")
    if isinstance(x, list):
        return Several([parse(file, v, depth + 1) for v in x])
    d = x.dict if isinstance(x, Stream) else x
    if not isinstance(d, dict):
        raise PdfError("no function")
    numbers = lambda k, default=None: [float(file.resolve(v)) for v in got] if isinstance(got := file.resolve(d.get(k)), list) else default
    kind, domain, range_ = file.resolve(d.get("FunctionType")), numbers("Domain", [0.0, 1.0]), numbers("Range")
    if kind == 2:
        n = file.resolve(d.get("N"))
        return Exponential(domain, range_, numbers("C0", [0.0]), numbers("C1", [1.0]), float(n) if isinstance(n, (int, float)) else 1.0)
    if kind == 3:
        parts = [parse(file, f, depth + 1) for f in file.resolve(d.get("Functions")) or []]
        if not parts:
            raise PdfError("stitching without functions")
        return Stitching(domain, range_, parts, numbers("Bounds", []), numbers("Encode", [0.0, 1.0] * len(parts)))
    if kind == 0 and isinstance(x, Stream) and range_:
        size = [int(v) for v in numbers("Size", [2.0])]
        return Sampled(domain, range_, size, int(file.resolve(d.get("BitsPerSample")) or 8), numbers("Encode", [v for s in size for v in (0.0, s - 1.0)]), numbers("Decode", range_), file.decoded(x))
    if kind == 4 and isinstance(x, Stream):
        return Calculator(domain, range_, file.decoded(x))
    raise PdfError("unsupported function")
