"""A PDF file: cross-references, indirect objects, decryption, streams and the page tree."""

from __future__ import annotations

import re
from typing import NamedTuple

from vellum.kernel import crypto, filters
from vellum.kernel.objects import END, Keyword, Name, Parser, PdfError, Ref, Stream

_ENTRIES = re.compile(rb"[\0\t\n\f\r ]*((?:\d{10} \d{5} [nf](?: \n| \r|\r\n))*)")
_STARTXREF = re.compile(rb"startxref\s+(\d+)")


class Page(NamedTuple):
    index: int
    ref: Ref | None
    dict: dict
    box: tuple[float, float, float, float]
    rotation: int
    resources: dict


class File:
    """Newer sections win; generation numbers are not compared; a missing object is null."""

    def __init__(self, data: bytes, password: str | None = None):
        self.data = data
        self.table: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.handler: crypto.Handler | None = None
        self.handler_supported = True
        self.encrypt_ref: int | None = None
        self._objects: dict[int, object] = {}
        self._members: dict[int, tuple[Stream, list[tuple[int, int]], bytes]] = {}
        self._loading: set[int] = set()
        self._sections()
        self._security(password or "")

    # Cross-references.

    def _sections(self) -> None:
        found = _STARTXREF.findall(self.data[-2048:])
        if not found:
            raise PdfError("startxref not found")
        queue, seen = [int(found[-1])], set()
        while queue:
            at = queue.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if not 0 <= at < len(self.data):
                raise PdfError("xref offset is outside the file")
            trailer = self._section(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            for k in ("XRefStm", "Prev"):
                if isinstance(v := trailer.get(k), (int, float)) and v >= 0:
                    queue.append(int(v))
        if not self.trailer:
            raise PdfError("no trailer")

    def _section(self, at: int) -> dict:
        p = Parser(self.data, at)
        p.skip()
        if self.data.startswith(b"xref", p.pos):
            p.pos += 4
            while isinstance(first := p.next(), int):
                n = p.next()
                if not isinstance(n, int):
                    raise PdfError("xref section is broken")
                m = _ENTRIES.match(self.data, p.pos)  # as most tables are written
                usual = min(max(n, 0), len(m[1]) // 20)
                for i in range(usual):
                    e = m.start(1) + 20 * i
                    self.table.setdefault(first + i, (1, int(self.data[e : e + 10]), int(self.data[e + 11 : e + 16])) if self.data[e + 17] == 0x6E else (0, 0, 0))
                if usual:
                    p.pos = m.start(1) + 20 * usual
                for i in range(usual, n):
                    offset, generation, kind = p.next(), p.next(), p.next()
                    if kind is END or not isinstance(offset, int):
                        break
                    if kind == "n":
                        self.table.setdefault(first + i, (1, offset, generation))
                    else:
                        self.table.setdefault(first + i, (0, 0, 0))
            if first != "trailer":
                raise PdfError("trailer not found")
            t = p.next()
            if not isinstance(t, dict):
                raise PdfError("trailer is no dictionary")
            return t
        if not (isinstance(p.next(), int) and isinstance(p.next(), int) and p.next() == "obj"):
            raise PdfError("cross-reference stream expected")
        s = p.value()
        if not isinstance(s, Stream):
            raise PdfError("cross-reference stream has no data")
        d = s.dict
        data = self.decoded(s)
        w = d.get("W")
        if not (isinstance(w, list) and len(w) >= 3 and all(isinstance(x, int) and 0 <= x <= 8 for x in w[:3])):
            raise PdfError("cross-reference stream lacks its widths")
        index = d.get("Index") if isinstance(d.get("Index"), list) else [0, d.get("Size", 0)]
        size, pos = sum(w[:3]), 0
        if not size:
            return d
        for first, n in zip(index[::2], index[1::2]):
            if not (isinstance(first, int) and isinstance(n, int)):
                break
            for i in range(n):
                if pos + size > len(data):
                    break
                a, b = pos + w[0], pos + w[0] + w[1]
                kind = int.from_bytes(data[pos:a], "big") if w[0] else 1
                self.table.setdefault(first + i, (kind, int.from_bytes(data[a:b], "big"), int.from_bytes(data[b : b + w[2]], "big")))
                pos += size
        return d

    # Objects.

    def resolve(self, x, depth: int = 0):
        while isinstance(x, Ref) and depth < 64:
            x, depth = self.object(x.number), depth + 1
        return None if isinstance(x, Ref) else x

    def object(self, number: int):
        if number in self._objects:
            return self._objects[number]
        entry = self.table.get(number)
        if entry is None or entry[0] not in (1, 2) or number in self._loading:
            return None
        self._loading.add(number)
        try:
            x = self._load(number, entry[1]) if entry[0] == 1 else self._member(entry[1], number)
        finally:
            self._loading.discard(number)
        self._objects[number] = x
        return x

    def _load(self, number: int, at: int):
        if not 0 <= at < len(self.data):
            return None
        p = Parser(self.data, at)
        own, generation, word = p.next(), p.next(), p.next()
        if not isinstance(own, int) or word != "obj":
            return None
        x = p.value()
        if isinstance(x, Stream) and isinstance(n := x.dict.get("Length"), Ref):
            # An indirect length may say more than the search for endstream.
            n = self.resolve(n)
            start = p.data.find(x.raw, at) if x.raw else -1
            if isinstance(n, int) and start >= 0 and n > len(x.raw) and self.data.find(b"endstream", start + n, start + n + 25) >= 0:
                x = Stream(x.dict, self.data[start : start + n])
        if self.handler and number != self.encrypt_ref:
            x = self._decrypted(x, number, generation if isinstance(generation, int) else 0)
        return x

    def _member(self, container: int, number: int):
        if container not in self._members:
            s = self.object(container)
            if not isinstance(s, Stream):
                return None
            data = self.decoded(s)
            n, first = self.resolve(s.dict.get("N")), self.resolve(s.dict.get("First"))
            if not isinstance(n, int) or not isinstance(first, int):
                return None
            p, pairs = Parser(data, 0, min(first, len(data))), []
            for _ in range(n):
                a, b = p.next(), p.next()
                if not (isinstance(a, int) and isinstance(b, int)):
                    break
                pairs.append((a, first + b))
            self._members[container] = s, pairs, data
        _, pairs, data = self._members[container]
        for a, at in pairs:
            if a == number:
                x = Parser(data, at).next()
                return None if isinstance(x, Keyword) or x is END else x
        return None

    # Security.

    def _security(self, password: str) -> None:
        ref = self.trailer.get("Encrypt")
        if ref is None:
            return
        self.encrypt_ref = ref.number if isinstance(ref, Ref) else None
        e = self.resolve(ref)
        if not isinstance(e, dict):
            return
        e = {k: self.resolve(v) for k, v in e.items()}
        if e.get("Filter") != "Standard":
            self.handler_supported = False
            return
        ids = self.resolve(self.trailer.get("ID"))
        first = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
        handler = crypto.Handler(e, first, password)
        self._objects.clear()
        self._members.clear()
        self.handler = handler

    def _decrypted(self, x, number: int, generation: int):
        if isinstance(x, bytes):
            return self.handler.decrypt(number, generation, x)
        if isinstance(x, list):
            return [self._decrypted(v, number, generation) for v in x]
        if isinstance(x, dict):
            return {k: self._decrypted(v, number, generation) for k, v in x.items()}
        if isinstance(x, Stream):
            if x.dict.get("Type") == "XRef" or (x.dict.get("Type") == "Metadata" and not self.handler.metadata):
                return x
            return Stream(self._decrypted(x.dict, number, generation), self.handler.decrypt(number, generation, x.raw))
        return x

    # Streams.

    def chain(self, s: Stream | dict) -> list[tuple[str, dict]]:
        """(filter, parameters) in order; references are followed."""
        d = s.dict if isinstance(s, Stream) else s
        names = self.resolve(d.get("Filter", d.get("F")))
        names = [self.resolve(n) for n in names] if isinstance(names, list) else [names] if isinstance(names, Name) else []
        parms = self.resolve(d.get("DecodeParms", d.get("DP")))
        parms = [self.resolve(p) for p in parms] if isinstance(parms, list) else [parms]
        out = []
        for i, n in enumerate(names):
            p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
            out.append((filters.SHORT.get(str(n), str(n)), {k: self.resolve(v) for k, v in p.items()}))
        return out

    def decoded(self, s: Stream) -> bytes:
        data = s.raw
        for name, parms in self.chain(s):
            data = filters.apply(name, data, parms)
        return data

    def image_data(self, s: Stream) -> tuple[str | None, dict, bytes]:
        """(image codec or None, its parameters, data): leading byte filters are undone first."""
        data = s.raw
        for name, parms in self.chain(s):
            if name in filters.IMAGE:
                return name, parms, data
            data = filters.apply(name, data, parms)
        return None, {}, data

    # Pages.

    def catalog(self) -> dict:
        c = self.resolve(self.trailer.get("Root"))
        if not isinstance(c, dict):
            raise PdfError("catalog can't be reached from /Root")
        return c

    def pages(self) -> list[Page]:
        out: list[Page] = []
        seen: set[int] = set()

        def box(x) -> tuple[float, float, float, float] | None:
            x = self.resolve(x)
            if isinstance(x, list) and len(x) >= 4:
                v = [self.resolve(k) for k in x[:4]]
                if all(isinstance(k, (int, float)) for k in v):
                    return min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])
            return None

        def walk(node, kept: tuple, depth: int) -> None:
            ref = node if isinstance(node, Ref) else None
            if ref:
                if ref.number in seen:
                    return
                seen.add(ref.number)
            d = self.resolve(node)
            if not isinstance(d, dict) or depth > 64:
                return
            rotate, resources = self.resolve(d.get("Rotate")), self.resolve(d.get("Resources"))
            kept = (box(d.get("MediaBox")) or kept[0], int(rotate) if isinstance(rotate, (int, float)) else kept[1], resources if isinstance(resources, dict) else kept[2])
            kids = self.resolve(d.get("Kids"))
            if isinstance(kids, list):
                for k in kids:
                    walk(k, kept, depth + 1)
            else:
                out.append(Page(len(out), ref, d, kept[0] or (0.0, 0.0, 612.0, 792.0), kept[1] % 360, kept[2]))

        root = self.catalog().get("Pages")
        if not isinstance(self.resolve(root), dict):
            raise PdfError("page tree is missing")
        walk(root, (None, 0, {}), 0)
        return out
