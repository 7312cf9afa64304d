"""A small JPEG 2000 encoder for tests: forward wavelets, bit-plane coding with plain neighbour look-ups, tag trees
and packets. It shares the arithmetic coder's table with the decoder and nothing else."""

import numpy as np

from tests.test_jbig2 import Encoder

BYPASS, RESET, TERMINATE, CAUSAL, SEGMARK = 1, 2, 4, 8, 32


def ceil(a, b):
    return -(-a // b)


def forward(a, start, reversible):
    """One step along the first axis: (low, high)."""
    n = len(a)
    if n == 1:
        return (a, a[:0]) if not start & 1 else (a[:0], a * 2)
    x = {i: a[i - start].astype(np.int64 if reversible else float) for i in range(start, start + n)}
    last = start + n - 1

    def at(i):
        while not start <= i <= last:
            i = 2 * start - i if i < start else 2 * last - i
        return x[i]

    odd, even = [i for i in x if i & 1], [i for i in x if not i & 1]
    if reversible:
        for i in odd:
            x[i] = x[i] - ((at(i - 1) + at(i + 1)) >> 1)
        for i in even:
            x[i] = x[i] + ((at(i - 1) + at(i + 1) + 2) >> 2)
    else:
        for k, which in ((-1.586134342059924, odd), (-0.052980118572961, even), (0.882911075530934, odd), (0.443506852043971, even)):
            for i in which:
                x[i] = x[i] + k * (at(i - 1) + at(i + 1))
        for i in odd:
            x[i] = x[i] * 1.230174104914001
        for i in even:
            x[i] = x[i] / 1.230174104914001
    shape = a.shape[1:]
    stack = lambda k: np.array([x[i] for i in k]).reshape(len(k), *shape)
    return stack(even), stack(odd)


def significance(kind, h, v, d):
    if kind == 1:
        h, v = v, h
    if kind < 3:
        if h == 2:
            return 8
        if h == 1:
            return 7 if v else 6 if d else 5
        return {2: 4, 1: 3}.get(v, min(d, 2))
    s = h + v
    if d >= 3:
        return 8
    if d == 2:
        return 7 if s else 6
    return (3 if d else 0) + min(s, 2)


def block_passes(values, kind, planes, flags):
    """[(raw or coded, bytes, passes)] of the segments of a block, and its empty planes."""
    h, w = values.shape
    m, neg = np.abs(values), values < 0
    top = int(m.max()).bit_length() if values.size else 0
    if not top:
        return [], planes
    sig = np.zeros((h, w), bool)
    first = np.ones((h, w), bool)
    fresh = lambda: [4 << 1] + [0] * 16 + [3 << 1, 46 << 1]
    contexts, out = fresh(), []
    coder, index, held = None, 0, 0
    text = []

    def is_sig(y, x, row):
        if not (0 <= y < h and 0 <= x < w):
            return 0
        if flags & CAUSAL and y // 4 > row // 4:
            return 0
        return int(sig[y, x])

    def counts(y, x):
        near = lambda dy, dx: is_sig(y + dy, x + dx, y)
        return near(0, -1) + near(0, 1), near(-1, 0) + near(1, 0), near(-1, -1) + near(-1, 1) + near(1, -1) + near(1, 1)

    def put(c, d):
        if raw:
            text.append(d)
        else:
            coder.bit(contexts, c, int(d))

    def put_sign(y, x):
        if raw:
            text.append(int(neg[y, x]))
        else:
            of = lambda dy, dx: is_sig(y + dy, x + dx, y) * (-1 if 0 <= y + dy < h and 0 <= x + dx < w and neg[y + dy, x + dx] else 1)
            a, b = np.clip(of(0, -1) + of(0, 1), -1, 1), np.clip(of(-1, 0) + of(1, 0), -1, 1)
            flip = a < 0 or (a == 0 and b < 0)
            if flip:
                a, b = -a, -b
            coder.bit(contexts, 9 if a == b == 0 else 10 if a == 0 else 12 + b, int(neg[y, x]) ^ int(flip))
        sig[y, x] = True

    def finish():
        nonlocal coder, text, held
        if held:
            out.append((flush(text) if raw else coder.end()[:-2], held))
        coder, text, held = None, [], 0

    raw = False
    total = 3 * top - 2
    for plane in range(top - 1, -1, -1):
        visited = np.zeros((h, w), bool)
        for step in (2,) if plane == top - 1 else (0, 1, 2):
            now_raw = bool(flags & BYPASS) and index >= 10 and step < 2
            new = flags & TERMINATE or (flags & BYPASS and index >= 10 and (step == 0 or step == 2))
            if held and (new or now_raw != raw):
                finish()
            raw = now_raw
            coder = coder or Encoder()
            for t in range(0, h, 4):
                for x in range(w):
                    rows = list(range(t, min(t + 4, h)))
                    if step == 2 and len(rows) == 4 and not any(sig[y, x] or visited[y, x] or sum(counts(y, x)) for y in rows):
                        ones = [k for k, y in enumerate(rows) if m[y, x] >> plane & 1]
                        put(17, bool(ones))
                        if not ones:
                            continue
                        put(18, ones[0] >> 1)
                        put(18, ones[0] & 1)
                        put_sign(t + ones[0], x)
                        rows = rows[ones[0] + 1 :]
                    for y in rows:
                        bit = int(m[y, x] >> plane & 1)
                        c = counts(y, x)
                        if step == 1:
                            if sig[y, x] and not visited[y, x]:
                                put(16 if not first[y, x] else 15 if sum(c) else 14, bit)
                                first[y, x] = False
                        elif not sig[y, x] and not visited[y, x] and (step == 2 or sum(c)):
                            visited[y, x] = step == 0
                            put(significance(kind, *c), bit)
                            if bit:
                                put_sign(y, x)
            held += 1
            index += 1
            if step == 2 and flags & SEGMARK:
                for b in (1, 0, 1, 0):
                    put(18, b)
            if flags & RESET:
                contexts = fresh()
    finish()
    assert index == total
    return out, planes - top


def flush(bits):
    """Raw bits with a zero bit after each byte of ones."""
    out, i = bytearray(), 0
    while i < len(bits):
        n = 7 if out and out[-1] == 0xFF else 8
        part = bits[i : i + n] + [0] * max(0, n - len(bits[i : i + n]))
        i += n
        v = 0
        for b in part:
            v = v << 1 | int(b)
        out.append(v)
    return bytes(out)


class Bits:
    def __init__(self):
        self.out, self.bits = bytearray(), []

    def put(self, v, n=1):
        self.bits += [v >> i & 1 for i in range(n - 1, -1, -1)]

    def bytes(self):
        out = bytearray(flush(self.bits))
        if out and out[-1] == 0xFF:
            out.append(0)
        return bytes(out)


class Tree:
    """A tag tree that writes its leaves."""

    def __init__(self, values):
        self.levels = [np.array(values)]
        while self.levels[-1].size > 1:
            a = self.levels[-1]
            h, w = ceil(a.shape[0], 2), ceil(a.shape[1], 2)
            self.levels.append(np.array([[a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].min() for x in range(w)] for y in range(h)]))
        self.low = [np.zeros(a.shape, int) for a in self.levels]
        self.done = [np.zeros(a.shape, bool) for a in self.levels]

    def write(self, bits, y, x, bound):
        low = 0
        for k in range(len(self.levels) - 1, -1, -1):
            i = (y >> k, x >> k)
            low = max(low, self.low[k][i])
            while low < bound and not self.done[k][i]:
                if low < self.levels[k][i]:
                    bits.put(0)
                    low += 1
                else:
                    bits.put(1)
                    self.done[k][i] = True
            self.low[k][i] = low


def encode(image, levels=2, reversible=True, mct=False, block=(4, 4), layers=1, flags=0, order=0, origin=(0, 0), tile=None, precinct=None, step=1 / 64, sop=False):
    """The codestream of (height, width, components) of 8 bits."""
    h, w, n = image.shape
    x0, y0 = origin
    tw, th = tile or (x0 + w, y0 + h)
    u = lambda v, k: int(v).to_bytes(k, "big")
    out = b"\xff\x4f" + b"\xff\x51" + u(38 + 3 * n, 2) + u(0, 2) + b"".join(u(v, 4) for v in (x0 + w, y0 + h, x0, y0, tw, th, 0, 0)) + u(n, 2) + b"\x07\x01\x01" * n
    size = u(precinct | precinct << 4, 1) * (levels + 1) if precinct else b""
    out += b"\xff\x52" + u(12 + len(size), 2) + u((1 if precinct else 0) | (6 if sop else 0), 1) + u(order, 1) + u(layers, 2) + u(mct, 1) + u(levels, 1) + u(block[0] - 2, 1) + u(block[1] - 2, 1) + u(flags, 1) + u(int(reversible), 1) + size
    guard, gains = 2, [(8, 0)] + [(8 + (1, 1, 2)[k], 0) for _ in range(levels) for k in range(3)]
    if not reversible:  # one step size for all bands, by its exponent
        gains = [(e - int(np.log2(step)), 0) for e, _ in gains]
    gains = [(e + 1, m) for e, m in gains] if mct else gains
    if not reversible and mct:
        step /= 2
    out += b"\xff\x5c" + (u(3 + len(gains), 2) + u(guard << 5, 1) + b"".join(u(e << 3, 1) for e, _ in gains) if reversible else u(3 + 2 * len(gains), 2) + u(guard << 5 | 2, 1) + b"".join(u(e << 11, 2) for e, _ in gains))
    across, down = ceil(x0 + w, tw), ceil(y0 + h, th)
    for t in range(across * down):
        i, j = t % across, t // across
        bx, by, ex, ey = max(x0, i * tw), max(y0, j * th), min(x0 + w, i * tw + tw), min(y0 + h, j * th + th)
        body = encode_tile(image[by - y0 : ey - y0, bx - x0 : ex - x0].astype(np.int64) - 128, (bx, by, ex, ey), levels, reversible, mct, block, layers, flags, order, precinct or 15, step, guard, gains, sop)
        out += b"\xff\x90" + u(10, 2) + u(t, 2) + u(14 + len(body), 4) + b"\0\1" + b"\xff\x93" + body
    return out + b"\xff\xd9"


def encode_tile(a, box, levels, reversible, mct, block, layers, flags, order, pp, step, guard, gains, sop):
    a = [a[..., c] for c in range(a.shape[2])]
    if mct:
        r, g, b = a[:3]
        a[:3] = [(r + 2 * g + b) >> 2, b - g, r - g] if reversible else [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    comps = []
    for c in a:
        bands, (x0, y0, x1, y1) = [], box
        for _ in range(levels):
            lo, hi = forward(c, y0, reversible)
            ll, hl = (v.T for v in forward(lo.T, x0, reversible))
            lh, hh = (v.T for v in forward(hi.T, x0, reversible))
            bands.append((hl, lh, hh, (x0, y0, x1, y1)))
            c, (x0, y0, x1, y1) = ll, tuple(ceil(v, 2) for v in (x0, y0, x1, y1))
        res = [([(0, c, (x0, y0))], (x0, y0, x1, y1))]
        for hl, lh, hh, (u0, v0, u1, v1) in reversed(bands):
            res.append(([(1, hl, (u0 // 2, ceil(v0, 2))), (2, lh, (ceil(u0, 2), v0 // 2)), (3, hh, (u0 // 2, v0 // 2))], (u0, v0, u1, v1)))
        comps.append(res)
    cells = {}
    for ci, res in enumerate(comps):
        for ri, (bands, (u0, v0, u1, v1)) in enumerate(res):
            left, top = u0 >> pp, v0 >> pp
            wide, high = (ceil(u1, 1 << pp) - left if u1 > u0 else 0), (ceil(v1, 1 << pp) - top if v1 > v0 else 0)
            q = pp if ri == 0 else pp - 1
            for p in range(wide * high):
                px, py = left + p % wide, top + p // wide
                made = []
                for kind, v, (ox, oy) in bands:
                    e = gains[0 if ri == 0 else 3 * (ri - 1) + kind][0]
                    v = v if reversible else (np.sign(v) * np.floor(np.abs(v) / step)).astype(np.int64)
                    cx, cy = min(block[0], q), min(block[1], q)
                    ax, ay = max(ox, px << q), max(oy, py << q)
                    zx, zy = min(ox + v.shape[1], (px + 1) << q), min(oy + v.shape[0], (py + 1) << q)
                    if ax >= zx or ay >= zy:
                        continue
                    grid = [[block_passes(v[max(ay, y << cy) - oy : min(zy, (y + 1) << cy) - oy, max(ax, x << cx) - ox : min(zx, (x + 1) << cx) - ox], kind, guard + e - 1, flags) for x in range(ax >> cx, ceil(zx, 1 << cx))] for y in range(ay >> cy, ceil(zy, 1 << cy))]
                    made.append(grid)
                d = 1 << (levels - ri)
                cells[ri, ci, p] = (made, (max(box[1], (py * d) << pp), max(box[0], (px * d) << pp)))
    by = [lambda k, l: (l, k[0], k[1], k[2]), lambda k, l: (k[0], l, k[1], k[2]), lambda k, l: (k[0], cells[k][1], k[1], k[2], l), lambda k, l: (cells[k][1], k[1], k[0], k[2], l), lambda k, l: (k[1], cells[k][1], k[0], k[2], l)][order]  # noqa: E741
    state, out = {}, b""
    for number, (key, layer) in enumerate(sorted(((k, n) for k in cells for n in range(layers)), key=lambda x: by(*x))):
        bits, data = Bits(), b""
        bits.put(1)
        for gi, grid in enumerate(cells[key][0]):
            # Segments are dealt out over the layers; blocks of none are never included.
            first = [[next((n for n in range(layers) if share(b[0], n, layers)), layers) for b in row] for row in grid]
            trees = state.setdefault((key, gi), (Tree(first), Tree([[b[1] for b in row] for row in grid])))
            for y, row in enumerate(grid):
                for x, b in enumerate(row):
                    take = share(b[0], layer, layers)
                    if first[y][x] < layer:
                        bits.put(int(bool(take)))
                    else:
                        trees[0].write(bits, y, x, layer + 1)
                    if not take:
                        continue
                    if first[y][x] == layer:
                        for bound in range(1, b[1] + 2):
                            trees[1].write(bits, y, x, bound)
                    passes = sum(p for _, p in take)
                    for low, prefix, n in ((1, (0, 1), 0), (2, (2, 2), 0), (3, (3, 2), 2), (6, (15, 4), 5), (37, (511, 9), 7)):
                        top = {1: 1, 2: 2, 3: 5, 6: 36, 37: 164}[low]
                        if low <= passes <= top:
                            bits.put(*prefix)
                            bits.put(passes - low, n)
                    length = state.setdefault((key, gi, y, x), [3])
                    need = max(len(d).bit_length() - (p.bit_length() - 1) for d, p in take)
                    while length[0] < need:
                        bits.put(1)
                        length[0] += 1
                    bits.put(0)
                    for d, p in take:
                        bits.put(len(d), length[0] + p.bit_length() - 1)
                        data += d
        out += (b"\xff\x91\0\4" + (number & 0xFFFF).to_bytes(2, "big") if sop else b"") + bits.bytes() + (b"\xff\x92" if sop else b"") + data
    return out


def share(segments, layer, layers):
    """The segments of a block that a layer has."""
    n = len(segments)
    return segments[n * layer // layers : n * (layer + 1) // layers]
