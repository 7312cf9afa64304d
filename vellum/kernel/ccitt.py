"""CCITT fax: Group 3 in one and two dimensions, and Group 4. Rows come as bits, 1 for black."""

from __future__ import annotations

import numpy as np

_WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
_BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
_WHITE_LONG = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
_BLACK_LONG = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
_LONGER = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
_MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "001": "H", "0001": "P"}


def _codes(short: str, long: str) -> dict[tuple[int, int], int]:
    out = {(len(c), int(c, 2)): i for i, c in enumerate(short.split())}
    out |= {(len(c), int(c, 2)): 64 * (i + 1) for i, c in enumerate(long.split())}
    return out | {(len(c), int(c, 2)): 1792 + 64 * i for i, c in enumerate(_LONGER.split())}


_RUNS = [_codes(_WHITE, _WHITE_LONG), _codes(_BLACK, _BLACK_LONG)]
_MODE = {(len(k), int(k, 2)): v for k, v in _MODES.items()}


class _Reader:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.pos = 0

    def match(self, table: dict, most: int = 13):
        v, b, p = 0, self.bits, self.pos
        for n in range(1, most + 1):
            if p + n > len(b):
                return None
            v = v << 1 | b[p + n - 1]
            if (n, v) in table:
                self.pos = p + n
                return table[n, v]
        return None

    def run(self, color: int):
        total = 0
        while (n := self.match(_RUNS[color])) is not None:
            total += n
            if n < 64:
                return total
        return None

    def end_of_line(self) -> bool:
        """Skips fill and an EOL if they are next."""
        p, b = self.pos, self.bits
        while p < len(b) and not b[p]:
            p += 1
        if p < len(b) and p - self.pos >= 11:
            self.pos = p + 1
            return True
        return False


def _one(r: _Reader, columns: int) -> list[int] | None:
    out, x, color = [], 0, 0
    while x < columns:
        n = r.run(color)
        if n is None:
            return None
        x = min(columns, x + n)
        out.append(x)
        color ^= 1
    return out


def _two(r: _Reader, above: list[int], columns: int) -> list[int] | None:
    """Changing elements of a row from those of the row above."""
    out: list[int] = []
    a0, color = -1, 0
    while a0 < columns:
        i = 0
        while i < len(above) and (above[i] <= a0 or i % 2 != color) and not (a0 < 0 and i % 2 == color and above[i] >= 0 and above[i] > a0):
            i += 1
        b1 = above[i] if i < len(above) else columns
        b2 = above[i + 1] if i + 1 < len(above) else columns
        mode = r.match(_MODE, 7)
        if mode is None:
            return None
        if mode == "P":
            a0 = b2
        elif mode == "H":
            first, second = r.run(color), r.run(color ^ 1)
            if first is None or second is None:
                return None
            a1 = min(columns, max(a0, 0) + first)
            a0 = min(columns, a1 + second)
            out += [a1, a0]
        else:
            a0 = min(columns, max(0, b1 + mode))
            out.append(a0)
            color ^= 1
    return out


def decode(data: bytes, k: int = 0, columns: int = 1728, rows: int = 0, black_is_1: bool = False, byte_align: bool = False) -> tuple[int, int, bytes]:
    """(columns, rows, packed bits): as many rows as there are, at most ``rows`` if given; a bad row ends it.
    Bits are 1 for white, as image samples are, unless ``black_is_1``."""
    r = _Reader(data)
    above: list[int] = []
    lines: list[list[int]] = []
    while (not rows or len(lines) < rows) and r.pos < len(r.bits) and len(lines) < 1 << 16:
        if byte_align:
            r.pos = -(-r.pos // 8) * 8
        marked = r.end_of_line() if k >= 0 else False
        if k < 0:
            at = r.pos
            if r.end_of_line():
                break
            r.pos = at
            line = _two(r, above, columns)
        elif k > 0 and marked and r.pos < len(r.bits):
            r.pos += 1
            line = _one(r, columns) if r.bits[r.pos - 1] else _two(r, above, columns)
        else:
            line = _one(r, columns)
        if line is None:
            break
        lines.append(line)
        above = line
    out = np.zeros((len(lines), columns), np.uint8)
    for i, line in enumerate(lines):
        for a, b in zip(line[::2], line[1::2] + [columns]):
            out[i, a:b] = 1
    return columns, len(lines), np.packbits(out if black_is_1 else 1 - out, axis=1).tobytes()
