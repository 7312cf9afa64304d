"""Makes PDF bytes of texts: pages of lines, with options for the variants that readers meet. For tests and
for measuring at scale; everything here is deterministic, and none of it is safe to keep secrets with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.kernel import crypto
from vellum.session import ship

WIDTH, LINES = 80, 50
#: How text can be encoded: in WinAnsi; with other codes named by Differences; as two-byte codes with a ToUnicode map.
FONTS = ("winansi", "differences", "composite")
_NAMES = {"é": "eacute", "ó": "oacute", "ñ": "ntilde", "ü": "udieresis", "ß": "germandbls", "ç": "ccedilla", "ä": "adieresis", "ö": "odieresis", "è": "egrave"}


def lines_of(text: str) -> list[str]:
    """Lines of 80 characters at most, without control characters and what WinAnsi doesn't have; empty ones go."""
    plain = re.sub(r"[\x00-\x09\x0B-\x1F\x7F]", "", text).encode("cp1252", "ignore").decode("cp1252")
    return [part for line in plain.split("\n") for i in range(0, len(line), WIDTH) if (part := line[i : i + WIDTH])]


def escaped(text: str) -> bytes:
    return text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252")


class Font:
    """Object 3 and what belongs to it, and how a line is shown."""

    def __init__(self, kind: str, lines: list[str]):
        self.kind = kind
        chars = sorted(set("".join(lines)))
        if kind == "composite":
            self.code = {c: i + 1 for i, c in enumerate(chars)}
            self._shown = str.maketrans({c: f"{i:04X}" for c, i in self.code.items()})
        else:
            other = [c for c in chars if c > "~"]
            self.code = {c: 0x80 + i for i, c in enumerate(other)} if kind == "differences" else {}
            self._shown = str.maketrans({c: f"{i:02x}" for c, i in self.code.items()} | {chr(i): f"{i:02x}" for i in range(0x20, 0x7F)}) if kind == "differences" else {}

    def shown(self, line: str) -> bytes:
        if self.kind != "winansi":
            return b"<" + line.translate(self._shown).encode() + b">"
        return b"(" + escaped(line) + b")"

    def lines(self, lines: list[str]) -> bytes:
        """All lines as they are shown; none has a line feed."""
        if not lines:
            return b""
        between = (b"(", b") Tj T*\n") if self.kind == "winansi" else (b"<", b"> Tj T*\n")
        whole = "\n".join(lines)
        whole = escaped(whole) if self.kind == "winansi" else whole.translate(self._shown).encode()
        return between[0] + whole.replace(b"\n", between[1] + between[0]) + between[1]

    def objects(self, free: int) -> dict[int, bytes]:
        """Objects 3 and, for a composite font, ``free`` and the next."""
        if self.kind == "differences":
            names = b" ".join(b"/" + (_NAMES.get(c) or f"uni{ord(c):04X}").encode() for c in self.code)
            return {3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [128 %s] >> >>" % names}
        if self.kind == "winansi":
            return {3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
        pairs = [b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().upper().encode()) for c, i in self.code.items()]
        blocks = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(pairs[i : i + 100]), b"\n".join(pairs[i : i + 100])) for i in range(0, len(pairs), 100))
        map_ = b"/CIDInit /ProcSet findresource begin\nbegincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + blocks + b"endcmap\nend\n"
        return {
            3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (free, free + 1),
            free: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Any /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /W [1 [600 550] 3 9 480] >>",
            free + 1: stream(b"/Filter /FlateDecode", zlib.compress(map_)),
        }


def page_content(lines: list[str], extra: bytes = b"", font: Font | None = None) -> bytes:
    font = font or Font("winansi", lines)
    return b"BT /F1 12 Tf 14 TL 40 760 Td\n" + font.lines(lines) + b"ET\n" + extra


def document(objects: dict[int, bytes], root: int = 1, xref_stream: bool = False, trailer: bytes = b"", packed: bool = False, before: bytes = b"") -> bytes:
    """A file of numbered objects, with a classic table or a cross-reference stream. ``packed``: what is no stream
    goes into an object stream. ``before``: a whole file that this one's objects are appended to."""
    out, at = bytearray(before or b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    size = max(objects) + 1
    inside: dict[int, tuple[int, int]] = {}
    if packed:
        loose = {n: b for n, b in objects.items() if b"stream\n" not in b}
        head, body = b"", b""
        for i, (n, b) in enumerate(sorted(loose.items())):
            head += b"%d %d " % (n, len(body))
            body += b + b" "
            inside[n] = (size, i)
        objects = {n: b for n, b in objects.items() if n not in loose} | {size: stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(loose), len(head)), zlib.compress(head + body))}
        size, xref_stream = size + 1, True
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    if before:
        trailer += b" /Prev %d" % int(before[before.rindex(b"startxref") + 9 :].split()[0])
        out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in sorted(at.items()))
        out += b"trailer\n<< /Size %d /Root %d 0 R %s >>\n" % (size, root, trailer)
    elif xref_stream:
        rows = b"".join(b"\2" + inside[n][0].to_bytes(4, "big") + inside[n][1].to_bytes(2, "big") if n in inside else b"\1" + at[n].to_bytes(4, "big") + b"\0\0" if n in at else b"\0" * 7 for n in range(size))
        rows += b"\1" + start.to_bytes(4, "big") + b"\0\0"
        data = zlib.compress(rows)
        out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root %d 0 R /Filter /FlateDecode /Length %d %s >>\nstream\n" % (size, size + 1, root, len(data), trailer) + data + b"\nendstream\nendobj\n"
    else:
        out += b"xref\n0 %d\n" % size + b"0000000000 65535 f \n"
        out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n" for n in range(1, size))
        out += b"trailer\n<< /Size %d /Root %d 0 R %s >>\n" % (size, root, trailer)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def secured(objects: dict[int, bytes], revision: int, password: bytes = b"") -> tuple[dict[int, bytes], bytes]:
    """(objects with their streams encrypted for a user's password, the trailer's entries): revisions 2 and 3 are
    RC4 with 40 and 128 bits, 4 is AES with 128 and 6 with 256. Their strings must be empty of parentheses."""
    file_id, permissions, owner, iv = b"0123456789abcdef", -44, bytes(range(32)), bytes(range(16))
    pad = lambda d: d + bytes([16 - len(d) % 16]) * (16 - len(d) % 16)
    if revision == 6:
        key, vs, ks = bytes(range(32)), b"validate", b"keysaltk"
        u = crypto.hash_2b(password, vs, b"", 6) + vs + ks
        ue = crypto.aes_cbc_encrypt(crypto.hash_2b(password, ks, b"", 6), bytes(16), key)
        d = b"<< /Filter /Standard /V 5 /R 6 /Length 256 /P %d /O <%s> /U <%s> /OE <%s> /UE <%s> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>" % (permissions, bytes(48).hex().encode(), u.hex().encode(), bytes(32).hex().encode(), ue.hex().encode())
    else:
        n = 16 if revision > 2 else 5
        key = hashlib.md5((password + crypto.PAD)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        u = crypto.user_entry(key, file_id, revision) + bytes(16 if revision > 2 else 0)
        cf = b" /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF" if revision == 4 else b""
        d = b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s>%s >>" % ({2: 1, 3: 2, 4: 4}[revision], revision, n * 8, permissions, owner.hex().encode(), u.hex().encode(), cf)
    out = {}
    for i, body in objects.items():
        if b"stream\n" in body:
            head, data = body[: body.index(b" /Length ")], body[body.index(b"stream\n") + 7 : -len(b"\nendstream")]
            own = key if revision == 6 else hashlib.md5(key + i.to_bytes(4, "little")[:3] + b"\0\0" + (b"sAlT" if revision == 4 else b"")).digest()[: min(16, len(key) + 5)]
            body = stream(head[3:], iv + crypto.aes_cbc_encrypt(own, iv, pad(data)) if revision >= 4 else crypto.rc4(own, data))
        out[i] = body
    last = max(objects) + 1
    return out | {last: d}, b"/Encrypt %d 0 R /ID [<%s> <%s>]" % (last, file_id.hex().encode(), file_id.hex().encode())


def stream(d: bytes, data: bytes) -> bytes:
    return b"<< " + d + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


@dataclass
class Variant:
    """What a file has besides its text: packed streams, a cross-reference stream, rulings, an image, a form field of
    this value; how its font encodes it; objects in an object stream; encryption of a revision, with no password;
    a later section that mends its first page; text in a form XObject."""

    flate: bool = True
    xref_stream: bool = False
    ruled: bool = False
    image: bool = False
    field: str | None = None
    font: str = "winansi"
    packed: bool = False
    secure: int = 0
    revised: bool = False
    nested: bool = False


FLAGS = {"flate": "boolean", "xref_stream": "boolean", "ruled": "boolean", "image": "boolean", "field": "string", "font": "string", "packed": "boolean", "secure": "int", "revised": "boolean", "nested": "boolean"}


def text_pdf(text: str, *args, **kw) -> bytes:
    """A document of a text's lines in a ``Variant``; an empty text has one empty page."""
    v = Variant(*args, **kw)
    lines = lines_of(text)
    font = Font(v.font, lines)
    groups = [lines[i : i + LINES] for i in range(0, len(lines), LINES)] or [[]]
    kids, n = [], 4
    extra = (b"0 0 300 100 re S 10 10 m 200 10 l S\n" if v.ruled else b"") + (b"q 306 0 0 396 0 0 cm /Im0 Do Q\n" if v.image else b"")
    objects: dict[int, bytes] = {}
    if v.image:
        objects[n] = stream(b"/Type /XObject /Subtype /Image /Width 8 /Height 8 /ColorSpace /DeviceGray /BitsPerComponent 8", bytes(range(64)))
        picture, n = n, n + 1
    packed = lambda d, data: stream(d + b" /Filter /FlateDecode", zlib.compress(data)) if v.flate else stream(d, data)
    for g in groups:
        data = page_content(g, extra, font)
        more = b" /XObject << /Im0 %d 0 R >>" % picture if v.image else b""
        if v.nested:
            objects[n] = packed(b"/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Matrix [1 0 0 1 0 0] /Resources << /Font << /F1 3 0 R >>%s >>" % more, data)
            more, data, n = b" /XObject << /Fm0 %d 0 R >>" % n, b"q /Fm0 Do Q\n", n + 1
        objects[n] = packed(b"", data)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >>%s >>%s >>" % (n, more, b" /Annots [FIELD]" if v.field is not None and not kids else b"")
        kids.append(n + 1)
        n += 2
    objects[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 612 792] /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    objects |= font.objects(n)
    n = max(objects) + 1
    form = b""
    if v.field is not None:
        objects[n] = b"<< /Type /Annot /Subtype /Widget /FT /Tx /T (name) /TU (label) /V (%s) /Rect [10 20 110 40] >>" % escaped(v.field)
        form = b" /AcroForm << /Fields [%d 0 R] >>" % n
        objects[kids[0]] = objects[kids[0]].replace(b"FIELD", b"%d 0 R" % n)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R%s >>" % form
    if v.revised:
        first = kids[0] - 1
        before = document(objects | {first: stream(b"", b"BT /F1 12 Tf 40 760 Td (an older text) Tj ET")})
        return document({first: objects[first], max(objects): objects[max(objects)]}, before=before)
    trailer = b""
    if v.secure:
        objects, trailer = secured(objects, v.secure)
    return document(objects, 1, v.xref_stream, trailer, v.packed and not v.secure)


def pdfs(texts: DataFrame) -> DataFrame:
    """(doc_id, content) from (doc_id, text) and, where they are there, the columns of FLAGS, which are the fields of
    ``Variant``; nulls are its defaults. Null texts are empty documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, *rest = (c.to_pylist() for c in b.columns)
            made = [text_pdf(t or "", **{k: x for k, x in zip(FLAGS, values) if x is not None}) for t, *values in zip(*rest)]
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array(made, pa.binary())], ["doc_id", "content"])

    ship(texts.sparkSession)
    flags = [F.col(k) if k in texts.columns else F.lit(None).cast(t).alias(k) for k, t in FLAGS.items()]
    return texts.select(F.col("doc_id").cast("long"), "text", *flags).mapInArrow(run, "doc_id string, content binary")
