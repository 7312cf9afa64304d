"""PDF objects: lexer and parser over one document's bytes.

Objects are Python's own: None, bool, int, float, bytes (strings), list, dict with str keys, and three of ours:
``Name``, ``Ref`` and ``Stream``. The parser never raises on stray delimiters: each step consumes a byte.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class PdfError(Exception):
    """The document breaks a rule of the format."""


class Name(str):
    __slots__ = ()


class Keyword(str):
    """A bare word that is no object: an operator, obj, endobj, stream ..."""

    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, d: dict, raw: bytes):
        self.dict, self.raw = d, raw


class _End:
    def __repr__(self) -> str:
        return "END"


END = _End()
WHITE = b"\0\t\n\f\r "
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)")
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f"}
_NAME_HEX = re.compile(r"#([0-9A-Fa-f]{2})")
_LITERALS = {b"true": True, b"false": False, b"null": None}
_CLOSE = Keyword("]"), Keyword(">>")
_PLAIN = re.compile(rb"[^\\()\r]*")
_NO_HEX = bytes(set(range(256)) - set(b"0123456789abcdefABCDEF"))


class Parser:
    """Reads objects from ``data`` at ``pos``."""

    def __init__(self, data: bytes, pos: int = 0, end: int | None = None):
        self.data, self.pos, self.end = data, pos, len(data) if end is None else end

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos, self.end).end()

    def next(self, depth: int = 0):
        """The next object or keyword; END at the end. Deep nesting ends in an error, not in recursion."""
        if depth > 200:
            raise PdfError("nested too deep")
        d, p = self.data, self.pos
        if p >= self.end:
            return END
        c = d[p]
        if c in b"\0\t\n\f\r %":
            self.skip()
            p = self.pos
            if p >= self.end:
                return END
            c = d[p]
        if c == 0x2F:
            m = _REGULAR.match(d, p + 1, self.end)
            self.pos = m.end() if m else p + 1
            s = m.group().decode("latin-1") if m else ""
            return Name(_NAME_HEX.sub(lambda x: chr(int(x.group(1), 16)), s) if "#" in s else s)
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            if d[p + 1 : p + 2] == b"<":
                self.pos = p + 2
                return self._dictionary(depth)
            return self._hex()
        if c == 0x5B:
            self.pos = p + 1
            out = []
            while (x := self.next(depth + 1)) is not END and not (isinstance(x, Keyword) and x == "]"):
                if not isinstance(x, Keyword):
                    out.append(x)
                elif x in ("endobj", "endstream"):
                    break
            return out
        if c == 0x5D:
            self.pos = p + 1
            return Keyword("]")
        if c == 0x3E:
            self.pos = p + (2 if d[p + 1 : p + 2] == b">" else 1)
            return Keyword(">>" if self.pos == p + 2 else ">")
        if c in b"+-.0123456789":
            m = _NUMBER.match(d, p, self.end)
            if m:
                self.pos = m.end()
                return self._number(m.group())
        m = _REGULAR.match(d, p, self.end)
        if not m:
            self.pos = p + 1
            return Keyword(chr(c))
        self.pos = m.end()
        w = m.group()
        if w in _LITERALS:
            return _LITERALS[w]
        if c in b"+-.0123456789" and not w.isalpha():
            m = re.match(rb"[+-]*(\d*\.?\d*)", w)
            if m and m.group(1).strip(b"."):
                return self._number(m.group())
        return Keyword(w.decode("latin-1"))

    def _number(self, w: bytes):
        if len(w) < 18 and w.isdigit():
            m = _REFERENCE.match(self.data, self.pos, self.end) if self.data[self.pos : self.pos + 1].isspace() or self.data[self.pos : self.pos + 1] == b"\0" else None
            if m is None:
                return int(w)
            self.pos = m.end()
            return Ref(int(w), int(m.group(1)))
        sign = -1 if w.lstrip(b"+").startswith(b"-") else 1
        w = w.lstrip(b"+-")
        if b"." in w:
            return sign * float(w if w != b"." else b"0")
        v = sign * int(w)
        if not -(2**63) <= v < 2**63:
            return float(v)
        if sign > 0:
            m = _REFERENCE.match(self.data, self.pos, self.end)
            if m:
                self.pos = m.end()
                return Ref(v, int(m.group(1)))
        return v

    def _dictionary(self, depth: int) -> dict:
        out: dict = {}
        while True:
            k = self.next(depth + 1)
            if k is END or (isinstance(k, Keyword) and k in (">>", "endobj", "stream")):
                return out
            if not isinstance(k, Name):
                continue
            before = self.pos
            v = self.next(depth + 1)
            if v is END:
                return out
            if isinstance(v, Keyword):
                if v in (">>", "endobj"):
                    out[str(k)] = None
                    if v == "endobj":
                        self.pos = before
                    return out
                continue
            out[str(k)] = v

    def _hex(self) -> bytes:
        e = self.data.find(b">", self.pos, self.end)
        raw = self.data[self.pos + 1 : e if e >= 0 else self.end]
        self.pos = e + 1 if e >= 0 else self.end
        digits = raw.translate(None, _NO_HEX)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def _literal(self) -> bytes:
        d, m = self.data, _PLAIN.match(self.data, self.pos + 1, self.end)
        if (p := m.end()) < self.end and d[p] == 0x29:
            self.pos = p + 1
            return m.group()
        out, open_ = bytearray(m.group()), 1
        while p < self.end:
            c = d[p]
            if c == 0x5C:
                p += 1
                if p >= self.end:
                    break
                e = d[p]
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif 0x30 <= e <= 0x37:
                    v, n = 0, 0
                    while n < 3 and p < self.end and 0x30 <= d[p] <= 0x37:
                        v, n, p = v * 8 + d[p] - 0x30, n + 1, p + 1
                    out.append(v & 255)
                    continue
                elif e == 0x0D:
                    p += d[p + 1 : p + 2] == b"\n"
                elif e != 0x0A:
                    out.append(e)
            elif c == 0x28:
                open_ += 1
                out.append(c)
            elif c == 0x29:
                open_ -= 1
                if not open_:
                    p += 1
                    break
                out.append(c)
            elif c == 0x0D:
                out.append(0x0A)
                p += d[p + 1 : p + 2] == b"\n"
            else:
                m = _PLAIN.match(d, p, self.end)
                out += m.group()
                p = m.end()
                continue
            p += 1
        self.pos = p
        return bytes(out)

    def value(self):
        """The next object, with its stream if one follows."""
        x = self.next()
        if isinstance(x, dict):
            here = self.pos
            self.skip()
            if self.data.startswith(b"stream", self.pos):
                return self._stream(x)
            self.pos = here
        return None if isinstance(x, Keyword) or x is END else x

    def _stream(self, d: dict) -> Stream:
        p = self.pos + 6
        p += 2 if self.data[p : p + 2] == b"\r\n" else self.data[p : p + 1] in (b"\n", b"\r")
        n = d.get("Length")
        if isinstance(n, int) and n >= 0 and self.data.find(b"endstream", p + n, p + n + 25) >= 0:
            self.pos = p + n
            return Stream(d, self.data[p : p + n])
        e = self.data.find(b"endstream", p)
        if e < 0:
            raise PdfError("endstream is missing")
        self.pos = e
        while e > p and self.data[e - 1] in b"\r\n" and self.pos - e < 2:
            e -= 1
        return Stream(d, self.data[p:e])
