"""Byte filters: Flate, LZW, ASCII85, ASCIIHex, RunLength and predictors. All take what they can from broken
input and never loop."""

from __future__ import annotations

import zlib

import numpy as np

from vellum.kernel.objects import PdfError


def flate(data: bytes) -> bytes:
    """Zlib or raw deflate; of a damaged stream what could be read."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        out = bytearray()
        try:
            out += d.decompress(data)
            return bytes(out + d.flush())
        except zlib.error:
            if bits == -15:
                break
            d = zlib.decompressobj(bits)
            for i in range(0, len(data), 256):  # again in parts, to keep what comes before the damage
                try:
                    out += d.decompress(data[i : i + 256])
                except zlib.error:
                    break
            if out:
                return bytes(out)
    raise PdfError("flate data can't be read")


def lzw(data: bytes, early: int = 1) -> bytes:
    out = bytearray()
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    bits = value = 0
    width, last = 9, b""
    for byte in data:
        value, bits = (value << 8) | byte, bits + 8
        while bits >= width:
            code = (value >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            value &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if code < len(table) and (code < 256 or code > 257):
                word = table[code]
            elif last:
                word = last + last[:1]
            else:
                return bytes(out)
            out += word
            if last and len(table) < 4096:
                table.append(last + word[:1])
            last = word
            n = len(table) + early
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    if data.lstrip()[:2] == b"<~":
        data = data.lstrip()[2:]
    for c in data:
        if c == 0x7E:
            break
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                v = 0
                for g in group:
                    v = v * 85 + g
                out += (v & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        v = 0
        for g in group + [84] * (5 - len(group)):
            v = v * 85 + g
        out += (v & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    e = data.find(b">")
    digits = bytes(c for c in (data if e < 0 else data[:e]) if c in b"0123456789abcdefABCDEF")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def predict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undoes PNG (10 and above) and, for eight bits, TIFF (2) prediction."""
    if predictor < 2:
        return data
    pixel, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2:
        if bits != 8:
            return data
        whole = len(data) // row * row
        a = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(a, 1, dtype=np.uint8).tobytes() + data[whole:]
    out = bytearray()
    above = np.zeros(row, np.uint8)
    for i in range(0, len(data), row + 1):
        kind = data[i]
        line = np.frombuffer(data[i + 1 : i + 1 + row], np.uint8)
        if not len(line):
            break
        if len(line) < row:
            line = np.concatenate([line, np.zeros(row - len(line), np.uint8)])
        if kind == 1:
            pad = -(-row // pixel) * pixel
            a = np.zeros(pad, np.uint8)
            a[:row] = line
            cur = np.cumsum(a.reshape(-1, pixel), 0, dtype=np.uint8).reshape(-1)[:row]
        elif kind == 2:
            cur = line + above
        elif kind in (3, 4):
            x, up = line.tolist(), above.tolist()
            for j in range(row):
                left = x[j - pixel] if j >= pixel else 0
                if kind == 3:
                    x[j] = (x[j] + (left + up[j]) // 2) & 255
                else:
                    corner = up[j - pixel] if j >= pixel else 0
                    p = left + up[j] - corner
                    pa, pb, pc = abs(p - left), abs(p - up[j]), abs(p - corner)
                    x[j] = (x[j] + (left if pa <= pb and pa <= pc else up[j] if pb <= pc else corner)) & 255
            cur = np.array(x, np.uint8)
        else:
            cur = line
        out += cur.tobytes()
        above = cur
    return bytes(out)


SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
IMAGE = frozenset(["DCTDecode", "CCITTFaxDecode", "JBIG2Decode", "JPXDecode"])


def apply(name: str, data: bytes, parms: dict) -> bytes:
    """One filter of a chain, with its predictor."""
    name = SHORT.get(name, name)
    number = lambda k, v: int(x) if isinstance(x := parms.get(k), (int, float)) else v
    if name == "FlateDecode":
        data = flate(data)
    elif name == "LZWDecode":
        data = lzw(data, number("EarlyChange", 1))
    elif name == "ASCII85Decode":
        return ascii85(data)
    elif name == "ASCIIHexDecode":
        return ascii_hex(data)
    elif name == "RunLengthDecode":
        return run_length(data)
    elif name == "Crypt":
        return data
    else:
        raise PdfError(f"unsupported filter {name}")
    return predict(data, number("Predictor", 1), number("Colors", 1), number("BitsPerComponent", 8), number("Columns", 1))
