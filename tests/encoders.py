"""Small encoders, to have images to decode: JPEG with Huffman tables of equal lengths, and Group 4."""

import numpy as np

from vellum.kernel import ccitt
from vellum.kernel.jpeg import _DCT, ZIGZAG


class Bits:
    def __init__(self):
        self.text = []

    def put(self, value, n):
        if n:
            self.text.append(format(value, f"0{n}b"))

    def number(self, v, n):
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def bytes(self):
        s = "".join(self.text)
        s += "1" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") if s else b""


def segment(marker, payload):
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload


def parts(a):
    """Quantised zigzag blocks of each component, without subsampling."""
    h, w, n = a.shape
    x = a.astype(float)
    if n == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        x = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], 2)
    x = np.pad(x, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    out = []
    for i in range(n):
        b = x[..., i].reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        out.append(np.round(_DCT @ b @ _DCT.T).astype(int).reshape(-1, 64)[:, ZIGZAG])
    return out


SYMBOLS = bytes(range(255))


def head(a, marker):
    h, w, n = a.shape
    table = lambda kind: bytes([kind]) + bytes([0] * 7 + [255] + [0] * 8) + SYMBOLS  # noqa: E731 - 255 codes of 8 bits
    frame = bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n))
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes([1] * 64)) + segment(marker, frame) + segment(0xC4, table(0x00)) + segment(0xC4, table(0x10))


def ac(bits, block, low, high):
    run = 0
    last = max((k for k in range(low, high + 1) if block[k]), default=-1)
    for k in range(low, last + 1):
        v = int(block[k])
        if not v:
            run += 1
            continue
        while run > 15:
            bits.put(0xF0, 8)
            run -= 16
        n = abs(v).bit_length()
        bits.put(run << 4 | n, 8)
        bits.number(v, n)
        run = 0
    if last < high:
        bits.put(0, 8)


def scan_of(ids, low, high, a):
    return segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i + 1, 0]) for i in ids) + bytes([low, high, a]))


def baseline_jpeg(a):
    p, bits, pred = parts(a), Bits(), [0] * a.shape[2]
    for b in range(len(p[0])):
        for i, c in enumerate(p):
            v = int(c[b][0]) - pred[i]
            pred[i] = int(c[b][0])
            n = abs(v).bit_length()
            bits.put(n, 8)
            bits.number(v, n)
            ac(bits, c[b], 1, 63)
    return head(a, 0xC0) + scan_of(range(a.shape[2]), 0, 63, 0) + bits.bytes() + b"\xff\xd9"


def progressive_jpeg(a):
    """DC in two passes, low AC at once, high AC in two passes by successive approximation."""
    p, out = parts(a), head(a, 0xC2)
    n = range(a.shape[2])
    bits, pred = Bits(), [0] * len(p)
    for b in range(len(p[0])):
        for i, c in enumerate(p):
            v = (int(c[b][0]) >> 1) - pred[i]
            pred[i] = int(c[b][0]) >> 1
            k = abs(v).bit_length()
            bits.put(k, 8)
            bits.number(v, k)
    out += scan_of(n, 0, 0, 0x01) + bits.bytes()
    bits = Bits()
    for b in range(len(p[0])):
        for c in p:
            bits.put(int(c[b][0]) & 1, 1)
    out += scan_of(n, 0, 0, 0x10) + bits.bytes()
    for i in n:
        bits = Bits()
        for block in p[i]:
            ac(bits, block, 1, 5)
        out += scan_of([i], 1, 5, 0) + bits.bytes()
    for i in n:
        bits = Bits()
        for block in p[i]:
            ac(bits, np.sign(block) * (np.abs(block) >> 1), 6, 63)
        out += scan_of([i], 6, 63, 0x01) + bits.bytes()
        bits = Bits()
        for block in p[i]:
            refine(bits, block, 6, 63)
        out += scan_of([i], 6, 63, 0x10) + bits.bytes()
    return out + b"\xff\xd9"


def refine(bits, block, low, high):
    big = [abs(int(v)) >> 1 for v in block]
    last = max((k for k in range(low, high + 1) if abs(int(block[k])) == 1), default=-1)
    run, held = 0, []
    for k in range(low, high + 1):
        v = int(block[k])
        if big[k]:
            held.append(abs(v) & 1)
        elif k > last:
            continue
        elif v == 0:
            if run == 15:
                bits.put(0xF0, 8)
                run = 0
                # the sixteenth zero ends the symbol; its corrections follow
                for h in held:
                    bits.put(h, 1)
                held = []
                continue
            run += 1
        else:
            bits.put(run << 4 | 1, 8)
            bits.put(1 if v > 0 else 0, 1)
            for h in held:
                bits.put(h, 1)
            run, held = 0, []
    if last < high:
        bits.put(0, 8)
        for h in held:
            bits.put(h, 1)


def group4(img):
    h, w = img.shape
    modes = {v: k for k, v in ccitt._MODES.items()}
    bits = []

    def run(n, c):
        longer, long, short = ccitt._LONGER.split(), (ccitt._BLACK_LONG if c else ccitt._WHITE_LONG).split(), (ccitt._BLACK if c else ccitt._WHITE).split()
        while n >= 2560:
            bits.append(longer[-1])
            n -= 2560
        if n >= 1792:
            bits.append(longer[(n - 1792) // 64])
            n %= 64
        elif n >= 64:
            bits.append(long[n // 64 - 1])
            n %= 64
        bits.append(short[n])

    changes = lambda row: [x for x in range(w) if row[x] != (row[x - 1] if x else 0)]
    above = np.zeros(w, int)
    for row in img:
        own, up, a0, c = changes(row), changes(above), -1, 0
        while a0 < w:
            a1 = next((x for x in own if x > a0 and row[x] == 1 - c), w)
            b1 = next((x for x in up if x > a0 and above[x] == 1 - c), w)
            b2 = next((x for x in up if x > b1), w)
            if b2 < a1:
                bits.append(modes["P"])
                a0 = b2
            elif abs(a1 - b1) <= 3:
                bits.append(modes[a1 - b1])
                a0, c = a1, c ^ 1
            else:
                a2 = next((x for x in own if x > a1), w)
                bits.append(modes["H"])
                run(a1 - max(a0, 0), c)
                run(a2 - a1, 1 - c)
                a0 = a2
        above = row
    s = "".join(bits) + "000000000001" * 2
    s += "0" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big")
