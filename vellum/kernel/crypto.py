"""Standard security handler: RC4, AES and the keys of revisions 2 to 6."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, j = bytearray(), 0
    for k in range(1, len(data) + 1):
        i = k & 255
        a = s[i]
        j = (j + a) & 255
        b = s[i] = s[j]
        s[j] = a
        out.append(s[(a + b) & 255])
    return (int.from_bytes(data, "little") ^ int.from_bytes(out, "little")).to_bytes(len(data), "little")


@lru_cache(64)  # copies of a file, and files of one writer, have its key
def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    """What /U begins with for a user's key of revisions 2 to 4."""
    if revision == 2:
        return rc4(key, PAD)
    x = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        x = rc4(bytes(b ^ i for b in key), x)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 255
    box = np.zeros(256, np.uint8)
    for v in range(256):
        i = exp[255 - log[v]] if v else 0
        r = i
        for _ in range(4):
            i = ((i << 1) | (i >> 7)) & 255
            r ^= i
        box[v] = r ^ 0x63
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256)
    times = {m: np.array([exp[log[m] + log[v]] if v else 0 for v in range(256)], np.uint8) for m in (2, 3, 9, 11, 13, 14)}
    return box, inverse, times


_BOX, _INVERSE, _TIMES = _tables()
_SHIFT = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
_BACK = np.argsort(_SHIFT)
_LIST = _BOX.tolist()
#: What a byte of each row gives to its column after substitution and mixing.
_COLUMNS = [[(b2 << 24 | v << 16 | v << 8 | b3) >> 8 * i | ((b2 << 24 | v << 16 | v << 8 | b3) << 32 - 8 * i & 0xFFFFFFFF) for v, b2, b3 in zip(_LIST, _TIMES[2][_BOX].tolist(), _TIMES[3][_BOX].tolist())] for i in range(4)]
#: What a byte of each row gives to its column after the way back of both; row r begins at 256 r.
_MIXED = np.concatenate([np.stack([_TIMES[(14, 9, 13, 11)[(i - r) % 4]][_INVERSE] for i in range(4)], 1) for r in range(4)]).copy().view(np.uint32).ravel()
_ROWS = np.tile(np.arange(4) * 256, 4)
_RING = [np.array([4 * c + (r + k) % 4 for c in range(4) for r in range(4)]) for k in range(4)]


@lru_cache(64)
def _expand(key: bytes) -> np.ndarray:
    n = len(key) // 4
    w = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = [int(_BOX[x]) for x in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and i % n == 4:
            t = [int(_BOX[x]) for x in t]
        w.append([a ^ b for a, b in zip(w[i - n], t)])
    k = np.array(w, np.uint8).reshape(-1, 16)
    k.flags.writeable = False
    return k


def _mix(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    out = np.zeros_like(s)
    for k, f in enumerate(factors):
        x = s[:, _RING[k]]
        out ^= x if f == 1 else _TIMES[f][x]
    return out


def aes_blocks_decrypt(key: bytes, data: bytes) -> np.ndarray:
    """All blocks at once: n x 16."""
    k = _expand(key)
    s = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ k[-1]
    for x in _mix(k[-2:0:-1], (14, 11, 13, 9)):
        m = _MIXED[s.take(_BACK, 1) + _ROWS]
        s = np.ascontiguousarray(m[:, ::4] ^ m[:, 1::4] ^ m[:, 2::4] ^ m[:, 3::4]).view(np.uint8) ^ x
    return _INVERSE[s.take(_BACK, 1)] ^ k[0]


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Without padding; whole blocks only."""
    data = data[: len(data) // 16 * 16]
    if not data:
        return b""
    before = np.frombuffer((iv + data)[: len(data)], np.uint8).reshape(-1, 16)
    return (aes_blocks_decrypt(key, data) ^ before).tobytes()


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Without padding, for hash 2.B. Block by block, a round by tables of whole columns."""
    k = [struct.unpack(">4I", row.tobytes()) for row in _expand(key)]
    (t0, t1, t2, t3), box = _COLUMNS, _LIST
    inner, (z0, z1, z2, z3), out = k[1:-1], k[-1], []
    p, q, r, s = (x ^ y for x, y in zip(struct.unpack(">4I", iv), k[0]))
    k0, k1, k2, k3 = k[0]
    for w0, w1, w2, w3 in struct.iter_unpack(">4I", data[: len(data) // 16 * 16]):
        a, b, c, d = p ^ w0, q ^ w1, r ^ w2, s ^ w3
        for x0, x1, x2, x3 in inner:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ x0, t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ x1,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ x2, t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ x3,
            )
        e = (box[a >> 24] << 24 | box[b >> 16 & 255] << 16 | box[c >> 8 & 255] << 8 | box[d & 255]) ^ z0
        f = (box[b >> 24] << 24 | box[c >> 16 & 255] << 16 | box[d >> 8 & 255] << 8 | box[a & 255]) ^ z1
        g = (box[c >> 24] << 24 | box[d >> 16 & 255] << 16 | box[a >> 8 & 255] << 8 | box[b & 255]) ^ z2
        h = (box[d >> 24] << 24 | box[a >> 16 & 255] << 16 | box[b >> 8 & 255] << 8 | box[c & 255]) ^ z3
        out += e, f, g, h
        p, q, r, s = e ^ k0, f ^ k1, g ^ k2, h ^ k3
    return struct.pack(f">{len(out)}I", *out)


def aes_unwrap(key: bytes, data: bytes) -> bytes:
    """IV in front, PKCS#7 behind; what can't be decrypted is empty."""
    if len(data) < 32 or len(data) % 16:
        return b""
    out = aes_cbc_decrypt(key, data[:16], data[16:])
    n = out[-1]
    return out[:-n] if 1 <= n <= 16 and out[-n:] == bytes([n]) * n else b""


@lru_cache(64)  # copies of a file have its salts
def hash_2b(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = aes_cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """``authentication`` is UserPassword, OwnerPassword or Failed; ``key`` is None in that case."""

    def __init__(self, encrypt: dict, file_id: bytes, password: str):
        number = lambda k, v: x if isinstance(x := encrypt.get(k), int) else v
        self.version, self.revision = number("V", 0), number("R", 2)
        self.permissions = number("P", 0)
        self.metadata = encrypt.get("EncryptMetadata") is not False
        self.length = number("Length", 40) // 8 if self.version in (2, 3) else 5 if self.version == 1 else 16
        self.method = "RC4"
        if self.version >= 4:
            cf = encrypt.get("CF") if isinstance(encrypt.get("CF"), dict) else {}
            std = cf.get(str(encrypt.get("StmF", "StdCF")))
            self.method = {"V2": "RC4", "AESV2": "AESV2", "AESV3": "AESV3", "None": "Identity"}.get(str(std.get("CFM", "None")) if isinstance(std, dict) else "None", "Identity")
        if self.version >= 5:
            self.method = "AESV3"
        self.algorithm = {"RC4": "Rc4", "AESV2": "Aes128", "AESV3": "Aes256"}.get(self.method, "Unknown")
        text = lambda k: x if isinstance(x := encrypt.get(k), bytes) else b""
        self.o, self.u, self.oe, self.ue, self.id = text("O"), text("U"), text("OE"), text("UE"), file_id
        self.key, self.authentication = self._new(password.encode("utf-8")[:127]) if self.revision >= 5 else self._old(password.encode("latin-1", "replace"))

    def _file_key(self, password: bytes) -> bytes:
        h = hashlib.md5((password + PAD)[:32] + self.o[:32] + (self.permissions & 0xFFFFFFFF).to_bytes(4, "little") + self.id)
        if self.revision >= 4 and not self.metadata:
            h.update(b"\xff\xff\xff\xff")
        k = h.digest()
        n = 5 if self.revision == 2 else self.length
        if self.revision >= 3:
            for _ in range(50):
                k = hashlib.md5(k[:n]).digest()
        return k[:n]

    def _user(self, password: bytes) -> bytes | None:
        key = self._file_key(password)
        x = user_entry(key, self.id, self.revision)
        return key if x == self.u[: len(x)] else None

    def _old(self, password: bytes) -> tuple[bytes | None, str]:
        if (key := self._user(password)) is not None:
            return key, "UserPassword"
        k = hashlib.md5((password + PAD)[:32]).digest()
        n = 5 if self.revision == 2 else self.length
        if self.revision >= 3:
            for _ in range(50):
                k = hashlib.md5(k).digest()
        k, user = k[:n], self.o[:32]
        for i in range(19 if self.revision >= 3 else 0, -1, -1):
            user = rc4(bytes(b ^ i for b in k), user)
        if (key := self._user(user)) is not None:
            return key, "OwnerPassword"
        return None, "Failed"

    def _new(self, password: bytes) -> tuple[bytes | None, str]:
        u, o = self.u[:48], self.o[:48]
        if len(u) < 48 or len(o) < 48:
            return None, "Failed"
        if hash_2b(password, u[32:40], b"", self.revision) == u[:32]:
            return aes_cbc_decrypt(hash_2b(password, u[40:48], b"", self.revision), bytes(16), self.ue[:32]), "UserPassword"
        if hash_2b(password, o[32:40], u, self.revision) == o[:32]:
            return aes_cbc_decrypt(hash_2b(password, o[40:48], u, self.revision), bytes(16), self.oe[:32]), "OwnerPassword"
        return None, "Failed"

    def decrypt(self, number: int, generation: int, data: bytes) -> bytes:
        if self.method == "Identity" or self.key is None:
            return data
        if self.method == "AESV3":
            return aes_unwrap(self.key, data)
        salt = number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if self.method == "AESV2" else b"")
        key = hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]
        return aes_unwrap(key, data) if self.method == "AESV2" else rc4(key, data)
