"""Colour spaces to RGB, on whole images: n x components floats to n x 3 bytes."""

from __future__ import annotations

import numpy as np

from vellum.kernel import functions
from vellum.kernel.objects import Name, PdfError, Stream

#: Rows: c c, c m, c y, c k, c, m m, m y, m k, m, y y, y k, y, k k, k; columns: red, green, blue.
_INK = np.array([
    [-4.387332384609988, 8.841041422036149, 0.8842522430003296], [54.48615194189176, 60.118027045597366, 8.078677503112928], [18.82290502165302, 6.871425592049007, 30.89978309703729], [212.25662451639585, 31.159100130055922, -0.23883238689178934],
    [-285.2331026137004, -79.2970844816548, -14.183576799673286], [1.7149763477362134, -15.310361306967817, 10.49593273432072], [-5.6096736904047315, 17.575251261109482, 63.02378494754052], [-17.873870861415444, 131.35250912493976, 50.606957656360734],
    [-5.497006427196366, -190.9453302588951, -112.23884253719248], [-2.5217340131683033, 4.444339102852739, 0.03296041114873217], [-21.248923337353073, 9.8632861493405, 115.60384449646641], [17.5119270841813, -24.86741582555878, -193.58209356861505],
    [-21.86122147463605, -20.737325471181034, -22.33816807309886], [-189.48180835922747, -187.80453709719578, -180.12613974708367],
])
_XYZ = np.array([[3.2406, -0.9689, 0.0557], [-1.5372, 1.8758, -0.2040], [-0.4986, 0.0415, 1.0570]])


def to_bytes(v: np.ndarray) -> np.ndarray:
    """Values of 0 to 1, rounded away from zero."""
    return np.floor(np.clip(np.nan_to_num(v), 0, 1) * 255 + 0.5).astype(np.uint8)


class Space:
    """``rgb`` takes components in their own ranges; ``decode`` is the default /Decode array."""

    def __init__(self, family: str, components: int):
        self.family, self.components = family, components

    def decode(self, bits: int) -> list[float]:
        return [0.0, 1.0] * self.components

    @property
    def gray(self) -> bool:
        return self.family in ("DeviceGray", "CalGray") or (self.family == "ICCBased" and self.components == 1)

    def rgb(self, x: np.ndarray) -> np.ndarray:
        if self.components == 1:
            return np.repeat(to_bytes(x[:, :1]), 3, 1)
        if self.components == 3:
            return to_bytes(x[:, :3])
        c, m, y, k = (np.clip(x[:, i], 0, 1) for i in range(4))
        terms = np.stack([c * c, c * m, c * y, c * k, c, m * m, m * y, m * k, m, y * y, y * k, y, k * k, k], 1)
        return np.clip(np.floor(255 + terms @ _INK + 0.5), 0, 255).astype(np.uint8)


class Lab(Space):
    def __init__(self, white: list[float], limits: list[float]):
        super().__init__("Lab", 3)
        self.white, self.limits = np.array(white), limits

    def decode(self, bits: int) -> list[float]:
        return [0.0, 100.0, *self.limits]

    def rgb(self, x: np.ndarray) -> np.ndarray:
        y = (x[:, 0] + 16) / 116
        f = np.stack([y + x[:, 1] / 500, y, y - x[:, 2] / 200], 1)
        d = 6 / 29
        linear = (np.where(f > d, f**3, 3 * d * d * (f - 4 / 29)) * self.white) @ _XYZ
        linear = np.clip(linear, 0, 1)
        return to_bytes(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055))


class Indexed(Space):
    def __init__(self, base: Space, high: int, table: bytes):
        super().__init__("Indexed", 1)
        n = base.components
        raw = np.frombuffer(table[: (high + 1) * n // n * n], np.uint8)
        raw = np.concatenate([raw, np.zeros(max(0, (high + 1) * n - len(raw)), np.uint8)]).reshape(-1, n) / 255
        low, top = np.array(base.decode(8)).reshape(-1, 2).T
        self.palette, self.high = base.rgb(low + raw * (top - low)), high

    def decode(self, bits: int) -> list[float]:
        return [0.0, float((1 << bits) - 1)]

    def rgb(self, x: np.ndarray) -> np.ndarray:
        return self.palette[np.clip(np.floor(x[:, 0] + 0.5), 0, self.high).astype(int)]


class Tint(Space):
    """Separation and DeviceN: inks through a function into another space."""

    def __init__(self, family: str, n: int, base: Space, f: functions.Function):
        super().__init__(family, n)
        self.base, self.f = base, f

    def rgb(self, x: np.ndarray) -> np.ndarray:
        one, back = np.unique(np.round(x, 6), axis=0, return_inverse=True)
        y = self.f(one)
        if y.shape[1] < self.base.components:
            y = np.concatenate([y, np.zeros((len(y), self.base.components - y.shape[1]))], 1)
        return self.base.rgb(y)[back.reshape(-1)]


def resolve(file, x, resources: dict | None = None, depth: int = 0) -> Space:
    """The colour space of a name or array. Patterns, and what can't be read, raise PdfError."""
    x = file.resolve(x)
    if depth > 8:
        raise PdfError("colour spaces nested too deep")
    if isinstance(x, Name):
        n = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}.get(str(x))
        if n:
            return Space({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n], n)
        named = file.resolve((resources or {}).get("ColorSpace"))
        if isinstance(named, dict) and named.get(str(x)) is not None:
            return resolve(file, named[str(x)], resources, depth + 1)
        raise PdfError(f"unsupported colour space {x}")
    if not isinstance(x, list) or not x:
        raise PdfError("no colour space")
    family = str(file.resolve(x[0]))
    arg = lambda i: file.resolve(x[i]) if len(x) > i else None
    if len(x) == 1:
        return resolve(file, Name(family), resources, depth + 1)
    if family in ("CalGray", "CalRGB"):
        return Space(family, 1 if family == "CalGray" else 3)
    if family == "ICCBased":
        s = arg(1)
        d = s.dict if isinstance(s, Stream) else {}
        n = file.resolve(d.get("N"))
        if d.get("Alternate") is not None:
            try:
                base = resolve(file, d["Alternate"], resources, depth + 1)
                if not isinstance(n, int) or base.components == n:
                    return base
            except PdfError:
                pass
        if n in (1, 3, 4):
            return Space("ICCBased", n)
        raise PdfError("unsupported profile")
    if family == "Lab":
        d = arg(1) if isinstance(arg(1), dict) else {}
        numbers = lambda k, default: [float(file.resolve(v)) for v in got] if isinstance(got := file.resolve(d.get(k)), list) else default
        return Lab(numbers("WhitePoint", [0.9505, 1.0, 1.089]), numbers("Range", [-100.0, 100.0, -100.0, 100.0]))
    if family in ("Indexed", "I"):
        table = arg(3)
        high = arg(2)
        return Indexed(resolve(file, x[1], resources, depth + 1), max(0, min(255, int(high) if isinstance(high, (int, float)) else 255)), file.decoded(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b"")
    if family in ("Separation", "DeviceN"):
        names = arg(1)
        n = len(names) if family == "DeviceN" and isinstance(names, list) else 1
        return Tint(family, n, resolve(file, x[2], resources, depth + 1), functions.parse(file, x[3]))
    raise PdfError(f"unsupported colour space {family}")


def unpack(data: bytes, width: int, height: int, components: int, bits: int) -> np.ndarray:
    """Samples as (height width) x components; rows begin at bytes; what is missing is 0."""
    row = (width * components * bits + 7) // 8
    a = np.frombuffer(data[: row * height], np.uint8)
    a = np.concatenate([a, np.zeros(row * height - len(a), np.uint8)]).reshape(height, row)
    if bits == 8:
        v = a
    elif bits == 16:
        v = a.reshape(height, -1, 2)[:, :, 0].astype(np.uint16) << 8 | a.reshape(height, -1, 2)[:, :, 1]
    elif bits in (1, 2, 4):
        b = np.unpackbits(a, axis=1).reshape(height, -1, bits)
        v = (b << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
    else:
        b = np.unpackbits(a, axis=1)[:, : width * components * bits].reshape(height, -1, bits)
        v = (b.astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(2)
    return v[:, : width * components].reshape(height * width, components)


def to_rgb(data: bytes, width: int, height: int, components: int, bits: int, space: Space, decode: list[float] | None = None) -> tuple[int, bytes]:
    """(1 or 3 components, samples): gray stays gray."""
    if min(width, height, components, bits) <= 0:
        return 1, b""
    raw = unpack(data, width, height, components, bits).astype(np.float64)
    d = list(decode) if decode else space.decode(bits)
    d = (d + [0.0, 1.0] * components)[: 2 * components] if len(d) < 2 * components else d[: 2 * components]
    low, high = np.array(d, float).reshape(-1, 2).T
    x = low + raw / ((1 << bits) - 1) * (high - low)
    if space.gray and components == 1:
        return 1, to_bytes(x[:, 0]).tobytes()
    if components < space.components:
        x = np.concatenate([x, np.zeros((len(x), space.components - components))], 1)
    return 3, space.rgb(x).tobytes()
