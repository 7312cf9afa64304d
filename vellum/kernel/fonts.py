"""Text of shown strings: code maps, encodings, widths, and how far each character can be trusted."""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Callable, Sequence

from vellum.kernel.objects import END, Keyword, Name, Parser, Stream

WIN = {c: chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x100)]} | dict(zip((0x85, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x99), "…‘’“”•–—™"))
_STANDARD = frozenset(["WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "PDFDocEncoding", "MacExpertEncoding"])
_PLAIN = (
    "# numbersign|$ dollar|% percent|& ampersand|' quotesingle|( parenleft|) parenright|* asterisk|+ plus|, comma|- hyphen|. period|/ slash|"
    ": colon|; semicolon|< less|= equal|> greater|? question|@ at|[ bracketleft|\\ backslash|] bracketright|^ asciicircum|_ underscore|` grave|{ braceleft|} braceright|~ asciitilde|"
    "¡ exclamdown|¢ cent|£ sterling|¥ yen|§ section|© copyright|« guillemotleft|® registered|° degree|± plusminus|¶ paragraph|· periodcentered|» guillemotright|¿ questiondown|× multiply|÷ divide|"
    "ß germandbls|Æ AE|æ ae|Ø Oslash|ø oslash|Œ OE|œ oe|– endash|— emdash|‘ quoteleft|’ quoteright|‚ quotesinglbase|“ quotedblleft|” quotedblright|„ quotedblbase|• bullet|… ellipsis|€ Euro|™ trademark|"
    "ﬁ fi|ﬂ fl|ﬀ ff|ﬃ ffi|ﬄ ffl|† dagger|‡ daggerdbl|‰ perthousand|‹ guilsinglleft|› guilsinglright|− minus|ı dotlessi|Ð Eth|ð eth|Þ Thorn|þ thorn|Ł Lslash|ł lslash|¹ onesuperior|² twosuperior|³ threesuperior|"
    "½ onehalf|¼ onequarter|¾ threequarters|ª ordfeminine|º ordmasculine|µ mu|¬ logicalnot|¦ brokenbar|¤ currency|¨ dieresis|´ acute|¸ cedilla|¯ macron|ƒ florin|ˆ circumflex|˜ tilde"
)
NAMES: dict[str, str] = {"space": " ", "exclam": "!", "quotedbl": '"', "nbspace": "\xa0", "bar": "|"}
for _pair in _PLAIN.split("|"):
    if len(_p := _pair.split(" ")) == 2:
        NAMES.setdefault(_p[1], _p[0])
NAMES |= dict(zip("zero one two three four five six seven eight nine".split(), "0123456789"))
for _base in "AEIOUYaeiouycnCNsSzZ":
    for _mark, _char in (("acute", "́"), ("grave", "̀"), ("circumflex", "̂"), ("dieresis", "̈"), ("tilde", "̃"), ("ring", "̊"), ("cedilla", "̧"), ("caron", "̌")):
        if len(_c := unicodedata.normalize("NFC", _base + _char)) == 1:
            NAMES.setdefault(_base + _mark, _c)


def glyph_text(name: str) -> str:
    """Text of a glyph's name; empty if it says nothing."""
    if name in NAMES:
        return NAMES[name]
    try:
        if name.startswith("uni") and len(name) >= 7 and (len(name) - 3) % 4 == 0:
            return "".join(chr(int(name[i : i + 4], 16)) for i in range(3, len(name), 4))
        if name.startswith("u") and 5 <= len(name) <= 7:
            return chr(int(name[1:], 16))
    except (ValueError, OverflowError):
        pass
    return name if len(name) == 1 else ""


def code_map(data: bytes) -> dict[int, str]:
    """bfchar and bfrange of a ToUnicode map."""
    out: dict[int, str] = {}
    p = Parser(data)
    number = lambda b: int.from_bytes(b, "big")
    text = lambda b: b[: len(b) // 2 * 2].decode("utf-16-be", "replace")
    while (x := p.next()) is not END:
        if not isinstance(x, Keyword):
            continue
        if x == "beginbfchar":
            while isinstance(a := p.next(), bytes) and isinstance(b := p.next(), bytes):
                out[number(a)] = text(b)
        elif x == "beginbfrange":
            while isinstance(a := p.next(), bytes) and isinstance(b := p.next(), bytes):
                to = p.next()
                low, high = number(a), number(b)
                if isinstance(to, bytes):
                    if len(to) < 2:
                        continue
                    last = number(to[-2:])
                    for c in range(low, min(high, low + 65_535) + 1):
                        out[c] = text(to[:-2] + ((last + c - low) & 0xFFFF).to_bytes(2, "big"))
                elif isinstance(to, list):
                    for c, t in enumerate((t for t in to if isinstance(t, bytes)), low):
                        out[c] = text(t)
                else:
                    break
    return out


def meaningful(text: str) -> bool:
    return any(c >= " " and c != "�" for c in text)


AUTHORITATIVE, FALLBACK, UNMAPPED = 0, 1, 2


class _Texts(dict):
    """A font's codes with their texts, worked out as they come."""

    def __init__(self, one: Callable):
        self.one, self.doubtful = one, {}

    def __missing__(self, code: int) -> str:
        text, _, _, tier = self.one(code)
        if tier:
            self.doubtful[code] = tier
        self[code] = text
        return text


class Font:
    """Texts, advances and trust of strings' codes; ``_one`` has (text, width, is space, tier) of a code."""

    def __init__(self, d: dict, resolve: Callable, decode: Callable):
        get = lambda x, k: resolve(x.get(k))
        self.wide = get(d, "Subtype") == "Type0"
        self.map: dict[int, str] | None = None
        if isinstance(s := get(d, "ToUnicode"), Stream):
            try:
                self.map = code_map(decode(s))
            except Exception:  # noqa: BLE001 - a broken map is none
                self.map = None
        self.widths: dict[int, float] = {}
        self.default = 1000.0 if self.wide else 500.0
        self.differences: dict[int, str] = {}
        self.standard = self.symbolic = False
        (self._composite if self.wide else self._simple)(d, resolve, get)
        self._texts = _Texts(self._one)
        #: Whether ASCII's printable codes are their own characters, as in most fonts.
        self._plain = not self.wide and self.map is None and not any(c < 0x80 for c in self.differences) and (self.standard or not self.symbolic)
        self._steps: tuple[tuple, dict[int, float]] = (), {}
        self.space = self._space()

    def _composite(self, d: dict, resolve: Callable, get: Callable) -> None:
        kids = get(d, "DescendantFonts")
        cid = resolve(kids[0]) if isinstance(kids, list) and kids else None
        if not isinstance(cid, dict):
            return
        if isinstance(w := get(cid, "DW"), (int, float)):
            self.default = float(w)
        w = get(cid, "W")
        w = [resolve(x) for x in w] if isinstance(w, list) else []
        i = 0
        while i + 1 < len(w):
            a, b = w[i], w[i + 1]
            if not isinstance(a, (int, float)):
                i += 1
            elif isinstance(b, list):
                self.widths |= {int(a) + j: float(v) for j, x in enumerate(b) if isinstance(v := resolve(x), (int, float))}
                i += 2
            elif isinstance(b, (int, float)) and i + 2 < len(w) and isinstance(w[i + 2], (int, float)):
                self.widths |= dict.fromkeys(range(int(a), min(int(b), int(a) + 69_999) + 1), float(w[i + 2]))
                i += 3
            else:
                i += 1

    def _simple(self, d: dict, resolve: Callable, get: Callable) -> None:
        first = get(d, "FirstChar")
        first = int(first) if isinstance(first, (int, float)) else 0
        if isinstance(w := get(d, "Widths"), list):
            self.widths = {first + i: float(v) for i, x in enumerate(w) if isinstance(v := resolve(x), (int, float)) and v > 0}
        if isinstance(x := get(d, "FontDescriptor"), dict) and isinstance(f := get(x, "Flags"), (int, float)):
            self.symbolic = bool(int(f) & 4) and not int(f) & 32
        e = get(d, "Encoding")
        base = e if isinstance(e, Name) else get(e, "BaseEncoding") if isinstance(e, dict) else None
        self.standard = base in _STANDARD
        if self.map is None and isinstance(e, dict) and isinstance(x := get(e, "Differences"), list):
            code = 0
            for item in map(resolve, x):
                if isinstance(item, Name):
                    self.differences[code] = glyph_text(str(item))
                    code += 1
                elif isinstance(item, int):
                    code = item

    def _space(self) -> float:
        code = next((c for c, t in self.map.items() if t == " "), -1) if self.wide and self.map else -1 if self.wide else 32
        em = self.widths.get(code, self.default) / 1000 if code >= 0 else 0.0
        return em if 0.01 < em < 1 else 0.25

    def _one(self, code: int) -> tuple[str, float, bool, int]:
        width, text = self.widths.get(code, self.default), self.map.get(code) if self.map is not None else None
        if self.wide:
            return text or "", width, False, AUTHORITATIVE if text and meaningful(text) else UNMAPPED
        if text is None:
            text = self.differences.get(code)
        if text is not None:
            return text, width, code == 32, AUTHORITATIVE if meaningful(text) else UNMAPPED
        text = WIN.get(code, "")
        return text, width, code == 32, UNMAPPED if not text else AUTHORITATIVE if self.standard or not self.symbolic else FALLBACK

    def codes(self, data: bytes) -> Sequence[int]:
        return struct.unpack_from(f">{len(data) // 2}H", data) if self.wide else data

    def text(self, codes: Sequence[int]) -> tuple[str, int, int]:
        """(text of all codes, how many fall back, how many have no text)."""
        texts = self._texts
        if self._plain and codes.isascii() and (out := codes.decode("ascii")).isprintable():
            return out, 0, 0
        out = "".join(map(texts.__getitem__, codes)) if self.wide else codes.decode("latin-1").translate(texts)
        if not texts.doubtful:
            return out, 0, 0
        tiers = [t for t in map(texts.doubtful.get, codes) if t]
        return out, tiers.count(FALLBACK), tiers.count(UNMAPPED)

    def advance(self, start: float, codes: Sequence[int], size: float, char: float, word: float, scale: float) -> float:
        """``start`` and each code's advance, added one by one; where all are the same and their sums have no
        rounding, at once."""
        if not self.widths and not (word and not self.wide and 32 in codes):
            step = (self.default / 1000 * size + char + 0.0) * scale
            if (step * 1024).is_integer() and (start * 1024).is_integer() and abs(start) + len(codes) * abs(step) < 1 << 40:
                return start + len(codes) * step
        if self._steps[0] != (size, char, word, scale):
            self._steps = (size, char, word, scale), {}
        steps = self._steps[1]
        for c in codes:
            s = steps.get(c)
            if s is None:
                s = steps[c] = (self.widths.get(c, self.default) / 1000 * size + char + (word if c == 32 and not self.wide else 0.0)) * scale
            start += s
        return start
