"""JPEG: header facts without pixels, and baseline, extended and progressive decoding."""

from __future__ import annotations

import numpy as np

from vellum.kernel.objects import PdfError

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_k = np.arange(8)
_DCT = np.where(_k[:, None] == 0, np.sqrt(0.125), 0.5 * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16))


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.id, self.h, self.v, self.table = ident, h, v, table
        self.dc = self.ac = self.pred = 0
        self.blocks_x = self.blocks_y = self.wide = 0
        self.data: np.ndarray = np.zeros((0, 64), np.int32)


def segments(data: bytes):
    """(marker, payload, end) of each segment up to the scan data of each SOS."""
    p = data.find(b"\xff\xd8")
    if p < 0:
        raise PdfError("no JPEG data")
    p += 2
    while p + 1 < len(data):
        if data[p] != 0xFF:
            p += 1
            continue
        m = data[p + 1]
        if m in (0xFF, 0x00) or 0xD0 <= m <= 0xD8 or m == 0x01:
            p += 1 if m == 0xFF else 2
            continue
        if m == 0xD9:
            return
        n = int.from_bytes(data[p + 2 : p + 4], "big")
        yield m, data[p + 4 : p + 2 + n], p + 2 + n
        p += 2 + max(2, n)


def metadata(data: bytes) -> dict:
    """Size, precision, components, sampling, process and Adobe transform."""
    out = {"width": 0, "height": 0, "precision": 0, "components": 0, "progressive": False, "restart_interval": 0, "adobe_transform": -1, "sampling": []}
    for m, s, _ in segments(data):
        if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC) and len(s) >= 6:
            n = s[5]
            out |= {"precision": s[0], "height": int.from_bytes(s[1:3], "big"), "width": int.from_bytes(s[3:5], "big"), "components": n, "progressive": m == 0xC2, "process": m, "sampling": [(s[7 + 3 * i] >> 4, s[7 + 3 * i] & 15) for i in range(n) if 7 + 3 * i < len(s)]}
        elif m == 0xDD and len(s) >= 2:
            out["restart_interval"] = int.from_bytes(s[:2], "big")
        elif m == 0xEE and s[:5] == b"Adobe" and len(s) >= 12:
            out["adobe_transform"] = s[11]
        elif m == 0xDA:
            break
    return out


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits."""
    out, code, k = [(0, 0)] * 65_536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if k >= len(symbols):
                return out
            first = code << (16 - length)
            span = 1 << (16 - length)
            if first + span > 65_536:
                return out
            out[first : first + span] = [(length, symbols[k])] * span
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.pos, self.value, self.left = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.left < n:
            p = self.pos
            self.value = (self.value << 8) | (self.data[p] if p < len(self.data) else 0)
            self.pos, self.left = p + 1, self.left + 8
        if self.pos > len(self.data) + 64:
            raise EOFError

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.left -= n
        v = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return v

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        n, s = table[(self.value >> (self.left - 16)) & 0xFFFF]
        if not n:
            raise EOFError
        self.left -= n
        self.value &= (1 << self.left) - 1
        return s


def _scans(data: bytes, start: int) -> tuple[list[bytes], int]:
    """Entropy-coded parts between restart markers, without stuffing, and where the scan ends."""
    parts, begin, p = [], start, start
    while True:
        p = data.find(b"\xff", p)
        if p < 0 or p + 1 >= len(data):
            return [*parts, data[begin:].replace(b"\xff\x00", b"\xff")], len(data)
        m = data[p + 1]
        if m == 0 or m == 0xFF:
            p += 2 if m == 0 else 1
        elif 0xD0 <= m <= 0xD7:
            parts.append(data[begin:p].replace(b"\xff\x00", b"\xff"))
            begin = p = p + 2
        else:
            return [*parts, data[begin:p].replace(b"\xff\x00", b"\xff")], p


def _zigzag_scan(bits: _Bits, c: Component, at: int, dc, ac, spectral: tuple[int, int, int, int], progressive: bool, state: list[int]) -> None:
    """One block of a scan into c.data[at]."""
    low, high, ah, al = spectral
    block = c.data[at]
    if not progressive:
        c.pred += bits.signed(bits.symbol(dc))
        block[0] = c.pred
        k = 1
        while k < 64:
            rs = bits.symbol(ac)
            r, s = rs >> 4, rs & 15
            if not s:
                if r < 15:
                    return
                k += 16
                continue
            k += r
            if k > 63:
                return
            block[k] = bits.signed(s)
            k += 1
        return
    if low == 0:
        if ah == 0:
            c.pred += bits.signed(bits.symbol(dc))
            block[0] = c.pred << al
        elif bits.read(1):
            block[0] |= 1 << al
        return
    if ah == 0:
        if state[0]:
            state[0] -= 1
            return
        k = low
        while k <= high:
            rs = bits.symbol(ac)
            r, s = rs >> 4, rs & 15
            if not s:
                if r < 15:
                    state[0] = (1 << r) - 1 + bits.read(r)
                    return
                k += 16
                continue
            k += r
            if k > 63:
                return
            block[k] = bits.signed(s) * (1 << al)
            k += 1
        return
    bit, k = 1 << al, low

    def refine(stop: int) -> None:
        """Correction bits of the coefficients up to where ``stop`` zeros have gone by."""
        nonlocal k
        while k <= high:
            v = int(block[k])
            if v:
                if bits.read(1) and not abs(v) & bit:
                    block[k] = v + (bit if v > 0 else -bit)
            elif stop == 0:
                return
            else:
                stop -= 1
            k += 1

    if not state[0]:
        while k <= high:
            rs = bits.symbol(ac)
            r, s = rs >> 4, rs & 15
            new = 0
            if s:
                new = bit if bits.read(1) else -bit
            elif r < 15:
                state[0] = (1 << r) + bits.read(r)
                break
            refine(r)
            if new and k <= high:
                block[k] = new
            k += 1
    if state[0]:
        refine(64)
        state[0] -= 1


def decode(data: bytes, keep_cmyk: bool = False) -> tuple[int, int, int, bytes]:
    """(width, height, components, samples): gray, RGB or, with keep_cmyk, inks. A damaged scan ends early;
    what it had is kept."""
    quant: dict[int, np.ndarray] = {}
    huff: dict[tuple[int, int], list] = {}
    parts: list[Component] = []
    width = height = restart = 0
    adobe, progressive, done = -1, False, 0
    for m, s, end in segments(data):
        if end < done:
            continue
        if m == 0xDB:
            p = 0
            while p < len(s):
                wide, t = s[p] >> 4, s[p] & 15
                n = 128 if wide else 64
                q = np.frombuffer(s[p + 1 : p + 1 + n], ">u2" if wide else np.uint8)
                if len(q) == 64:
                    quant[t] = q.astype(np.int32)
                p += 1 + n
        elif m == 0xC4:
            p = 0
            while p + 17 <= len(s):
                n = sum(s[p + 1 : p + 17])
                huff[s[p] >> 4, s[p] & 15] = _table(s[p + 1 : p + 17], s[p + 17 : p + 17 + n])
                p += 17 + n
        elif m == 0xDD:
            restart = int.from_bytes(s[:2], "big")
        elif m == 0xEE and s[:5] == b"Adobe" and len(s) >= 12:
            adobe = s[11]
        elif 0xC0 <= m <= 0xCF and m not in (0xC8, 0xCC):
            if m > 0xC2:
                raise PdfError("unsupported JPEG process")
            if len(s) < 6 or s[0] not in (8, 12) or len(s) < 6 + 3 * s[5]:
                raise PdfError("broken JPEG frame")
            progressive = m == 0xC2
            shift = s[0] - 8
            height, width = int.from_bytes(s[1:3], "big"), int.from_bytes(s[3:5], "big")
            parts = [Component(s[6 + 3 * i], max(1, s[7 + 3 * i] >> 4), max(1, s[7 + 3 * i] & 15), s[8 + 3 * i]) for i in range(s[5])]
            if not width or not height or len(parts) not in (1, 3, 4) or width * height > 1 << 28:
                raise PdfError("unsupported JPEG frame")
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
            for c in parts:
                c.wide = mx * c.h
                c.data = np.zeros((c.wide * my * c.v, 64), np.int32)
                c.blocks_x, c.blocks_y = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
        elif m == 0xDA and parts:
            own = []
            for i in range(s[0]):
                c = next((c for c in parts if c.id == s[1 + 2 * i]), None)
                if c is not None:
                    c.dc, c.ac = s[2 + 2 * i] >> 4, s[2 + 2 * i] & 15
                    own.append(c)
            low, high, a = s[1 + 2 * s[0] : 4 + 2 * s[0]]
            spectral = (low, high, a >> 4, a & 15)
            chunks, done = _scans(data, end)
            if len(own) == 1:
                c = own[0]
                units = [[(c, y * c.wide + x)] for y in range(c.blocks_y) for x in range(c.blocks_x)]
            else:
                units = [[(c, (y * c.v + v) * c.wide + x * c.h + h) for c in own for v in range(c.v) for h in range(c.h)] for y in range(my) for x in range(mx)]
            step = restart or len(units)
            for i, chunk in enumerate(chunks):
                bits, state = _Bits(chunk), [0]
                for c in own:
                    c.pred = 0
                try:
                    for unit in units[i * step : (i + 1) * step]:
                        for c, at in unit:
                            _zigzag_scan(bits, c, at, huff.get((0, c.dc)), huff.get((1, c.ac)), spectral, progressive, state)
                except (EOFError, TypeError, IndexError, OverflowError):
                    pass
    if not parts:
        raise PdfError("no JPEG frame")
    planes = []
    for c in parts:
        q = quant.get(c.table, np.ones(64, np.int32))
        f = np.zeros((len(c.data), 64))
        f[:, ZIGZAG] = c.data * q
        f = f.reshape(-1, 8, 8)
        px = np.clip(np.floor((_DCT.T @ f @ _DCT) / (1 << shift) + 128.5), 0, 255).astype(np.uint8)
        plane = px.reshape(-1, c.wide, 8, 8).swapaxes(1, 2).reshape(-1, c.wide * 8)
        planes.append(plane.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[:height, :width])
    x = np.stack(planes, 2).astype(np.float64)
    n = len(parts)
    if (n == 3 and adobe != 0 and not (adobe < 0 and [c.id for c in parts] == [82, 71, 66])) or (n == 4 and adobe == 2):
        y, cb, cr = x[..., 0], x[..., 1] - 128, x[..., 2] - 128
        x = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb, *([x[..., 3]] if n == 4 else [])], 2)
    x = np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
    if n == 4:
        ink = 255 - x if adobe >= 0 else x  # Adobe files hold inks inverted
        if keep_cmyk:
            return width, height, 4, ink.tobytes()
        from vellum.kernel.color import Space

        return width, height, 3, Space("DeviceCMYK", 4).rgb(ink.reshape(-1, 4) / 255).tobytes()
    return width, height, n, x.tobytes()
