"""The byte kernel: objects, filters, crypto, files, content, forms; it never raises."""

import base64
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.kernel import crypto, filters
from vellum.kernel.content import Interpreter
from vellum.kernel.facts import analyze
from vellum.kernel.fonts import code_map, glyph_text
from vellum.kernel.objects import END, Keyword, Name, Parser, Ref, Stream
from vellum.sources.synthesize import document, stream, text_pdf


class Nothing:
    def resolve(self, x):
        return x

    def decoded(self, s):
        return s.raw


@pytest.mark.parametrize("data,value", [
    (b"42", 42), (b"-17.5", -17.5), (b".5", 0.5), (b"/A#42c", Name("ABc")), (b"(a\\(b\\)c\\101\\n)", b"a(b)cA\n"), (b"(a(b)c)", b"a(b)c"), (b"<48656C6C6F7>", b"Hellop"),
    (b"[1 2 0 R true null]", [1, Ref(2, 0), True, None]), (b"<< /A 1 /B << /C [ (x) ] >> >>", {"A": 1, "B": {"C": [b"x"]}}), (b"% note\n7", 7), (b"99999999999999999999", 1e20),
])
def test_objects(data, value):
    assert Parser(data).next() == value


def test_streams_end_by_length_or_search():
    assert Parser(b"<< /Length 3 >>\nstream\nabc\nendstream").value().raw == b"abc"
    assert Parser(b"<< /Length 99 >>\nstream\nabc\nendstream").value().raw == b"abc"


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_parser_always_ends(data):
    p = Parser(data)
    for _ in range(len(data) + 2):
        if p.next() is END:
            return
    raise AssertionError("no end")


@given(st.binary(max_size=500))
@settings(max_examples=100, deadline=None)
def test_filters_round_trip(data):
    assert filters.flate(zlib.compress(data)) == data
    assert filters.ascii85(base64.a85encode(data) + b"~>") == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data


def test_lzw_and_run_length():
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"


def test_predictors():
    rows = [bytes([10, 20, 30, 40]), bytes([11, 22, 33, 44])]
    up = b"\2" + rows[0] + b"\2" + bytes((b - a) & 255 for a, b in zip(*rows))
    assert filters.predict(up, 12, 1, 8, 4) == b"".join(rows)
    sub = b"\1" + bytes([10, 10, 10, 10])
    assert filters.predict(sub, 11, 1, 8, 4) == rows[0]
    paeth = b"\4" + bytes([10, 10, 10, 10]) + b"\4" + bytes([1, 1, 1, 1])
    assert len(filters.predict(paeth, 14, 1, 8, 4)) == 8
    assert filters.predict(bytes([1, 1, 1]), 2, 1, 8, 3) == bytes([1, 2, 3])


def test_crypto_vectors():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    block = bytes.fromhex("6bc1bee22e409f96e93d7e117393172a")
    assert crypto.aes_cbc_encrypt(key, iv, block).hex() == "7649abac8119b246cee98e9b12e9197d"
    data = bytes(range(96))
    for k in (key, bytes(range(32))):
        assert crypto.aes_cbc_decrypt(k, iv, crypto.aes_cbc_encrypt(k, iv, data)) == data


def encrypted(revision: int, password: bytes = b"u") -> bytes:
    """A document whose page says Secret, encrypted for a user's password."""
    file_id, permissions, owner = b"0123456789abcdef", -44, bytes(range(32))
    content = b"BT /F1 12 Tf 72 700 Td (Secret) Tj ET"
    pad = lambda d: d + bytes([16 - len(d) % 16]) * (16 - len(d) % 16)
    iv = bytes(range(16))
    if revision == 6:
        key = bytes(range(32))
        vs, ks = b"validate", b"keysaltk"
        u = crypto.hash_2b(password, vs, b"", 6) + vs + ks
        ue = crypto.aes_cbc_encrypt(crypto.hash_2b(password, ks, b"", 6), bytes(16), key)
        d = b"<< /Filter /Standard /V 5 /R 6 /Length 256 /P %d /O <%s> /U <%s> /OE <%s> /UE <%s> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>" % (permissions, (bytes(48)).hex().encode(), u.hex().encode(), bytes(32).hex().encode(), ue.hex().encode())
        data = iv + crypto.aes_cbc_encrypt(key, iv, pad(content))
    else:
        n = 16 if revision > 2 else 5
        h = crypto.hashlib.md5((password + crypto.PAD)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
        for _ in range(50 if revision >= 3 else 0):
            h = hashlib.md5(h[:n]).digest()
        key = h[:n]
        if revision == 2:
            u = crypto.rc4(key, crypto.PAD)
        else:
            u = hashlib.md5(crypto.PAD + file_id).digest()
            for i in range(20):
                u = crypto.rc4(bytes(b ^ i for b in key), u)
            u += bytes(16)
        cf = b" /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF" if revision == 4 else b""
        d = b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s>%s >>" % ({2: 1, 3: 2, 4: 4}[revision], revision, n * 8, permissions, owner.hex().encode(), u.hex().encode(), cf)
        own = hashlib.md5(key + (4).to_bytes(4, "little")[:3] + b"\0\0" + (b"sAlT" if revision == 4 else b"")).digest()[: min(16, n + 5)]
        data = iv + crypto.aes_cbc_encrypt(own, iv, pad(content)) if revision == 4 else crypto.rc4(own, content)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 612 792] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 4: stream(b"", data), 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 6: d}
    return document(objects, 1, trailer=b"/Encrypt 6 0 R /ID [<%s> <%s>]" % (file_id.hex().encode(), file_id.hex().encode()))


@pytest.mark.parametrize("revision,algorithm", [(2, "Rc4"), (3, "Rc4"), (4, "Aes128"), (6, "Aes256")])
def test_encryption(revision, algorithm):
    data = encrypted(revision)
    r = analyze(data, "u")
    assert r["document"][0]["algorithm"] == algorithm and r["document"][0]["authentication"] == "UserPassword"
    assert [x["text"] for x in r["run"]] == ["Secret"]
    for wrong in ("x", None):
        r = analyze(data, wrong)
        assert "password" in r["document"][0]["error"] and not r["run"] and not r["document"][0]["is_encrypted"]


@pytest.mark.parametrize("content,rulings", [(b"0 0 100 100 re S 10 10 m 200 10 l S", 5), (b"0 0 m 5 0 l S 0 0 m 100 100 l S", 0), (b"0 0 200 200 re f", 0), (b"0 0 200 2 re f", 2)])
def test_rulings(content, rulings):
    assert Interpreter(Nothing()).run(content, {}).rulings == rulings


def test_text_state():
    font = {"Font": {"F1": {"Subtype": Name("Type1")}}}
    run = lambda c: Interpreter(Nothing()).run(c, font)
    assert [r.text for r in run(b"BT /F1 10 Tf [(a) -500 (b) 20 (c)] TJ ET").runs] == ["a bc"]
    assert run(b"BT 3 Tr /F1 10 Tf (x) Tj ET").runs[0].render_mode == 3
    assert run(b"/F1 12 Tf /F2 10 Tf /F1 8 Tf").fonts == {"F1", "F2"}
    r = run(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 6 Td (ab) Tj ET Q BT (c) Tj ET").runs
    assert (r[0].x, r[0].y, r[0].width, r[0].font_size) == (20, 32, 20, 20) and len(r) == 1
    r = run(b"BT /F1 10 Tf 12 TL 0 100 Td (a) ' (b) Tj T* (c) Tj ET").runs
    assert [x.y for x in r] == [88, 88, 76]


def test_inline_image_and_form_depth():
    r = Interpreter(Nothing()).run(b"q 72 0 0 72 0 0 cm BI /W 10 /H 10 /CS /G /BPC 8 ID abcEIx \nEI Q", {})
    assert r.images[0].name == "inline" and r.images[0].stream.dict["Width"] == 10
    loop = {"XObject": {}}
    loop["XObject"]["F"] = Stream({"Subtype": Name("Form")}, b"/F Do")
    assert Interpreter(Nothing()).run(b"/F Do", loop).runs == []


def test_code_maps_and_names():
    m = code_map(b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0030> <0031>] endbfrange")
    assert m == {1: "A", 16: "a", 17: "b", 18: "c", 32: "0", 33: "1"}
    assert [glyph_text(n) for n in ("eacute", "uni0041", "u1F600", "A", "nothing")] == ["é", "A", "😀", "A", ""]


def test_variants_say_the_same():
    text = "First (line)\nsecond \\ line\n" + "x" * 200
    for kw in ({}, {"flate": False}, {"xref_stream": True}, {"ruled": True, "image": True, "field": "v"}):
        r = analyze(text_pdf(text, **kw))
        assert r["document"][0]["error"] is None
        assert "".join(x["text"] for x in r["run"]) == text.replace("\n", "")
    assert r["field"][0]["value"] == "v" and r["field"][0]["page"] == 0 and r["image"][0]["px_w"] == 8 and r["page"][0]["ruling_line_count"] == 5


def test_inherited_attributes_and_object_streams():
    inner = b"4 0 5 62 << /Type /Page /Parent 2 0 R >> " + b" " * 20
    first = len(b"4 0 5 62 ")
    page2 = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 300] /Rotate 90 >>"
    body = b"4 0 5 %d " % (len(b"<< /Type /Page /Parent 2 0 R >> "))
    packed = body + b"<< /Type /Page /Parent 2 0 R >> " + page2
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 2 /Kids [4 0 R 5 0 R] /MediaBox [0 0 612 792] >>", 3: stream(b"/Type /ObjStm /N 2 /First %d" % len(body), packed)}
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, b in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + b + b"\nendobj\n"
    start = len(out)
    rows = bytes(7) + b"".join(b"\1" + at[n].to_bytes(4, "big") + b"\0\0" for n in (1, 2, 3)) + b"\2" + (3).to_bytes(4, "big") + b"\0\0" + b"\2" + (3).to_bytes(4, "big") + b"\0\1"
    out += b"6 0 obj\n" + stream(b"/Type /XRef /Size 6 /W [1 4 2] /Root 1 0 R", rows) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    r = analyze(bytes(out))
    assert r["document"][0]["error"] is None
    assert [(p["width"], p["height"], p["rotation"]) for p in r["page"]] == [(612, 792, 0), (200, 300, 90)]
    assert first and inner


def test_damaged_files_are_rows():
    base, rnd = text_pdf("some words\n" * 60, xref_stream=True), random.Random(3)
    for i in range(300):
        b = bytearray(base)
        for _ in range(rnd.randint(1, 25)):
            b[rnd.randrange(len(b))] = rnd.randrange(256)
        r = analyze(bytes(b[: rnd.randint(5, len(b))]) if i % 3 == 0 else bytes(b))
        assert len(r["document"]) == 1
    assert "startxref" in analyze(b"%PDF-1.4 nothing")["document"][0]["error"]
    assert analyze(b"")["document"][0]["error"]


def test_checkbox_and_names():
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /XFA (x) /Fields [4 0 R 6 0 R] >> >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 9 9] >>", 3: b"<< /Type /Page /Parent 2 0 R /Annots [5 0 R 6 0 R] >>",
        4: b"<< /T (a) /Kids [5 0 R] /FT /Btn >>", 5: b"<< /T (b) /AS /Yes /Rect [5 6 1 2] >>", 6: b"<< /T (c) /FT /Ch /V [(x) (y)] >>",
    }
    r = analyze(document(objects))
    f = r["field"]
    assert (f[0]["fqn"], f[0]["is_checked"], f[0]["value"], f[0]["rect"]) == ("a.b", True, "Yes", {"x": 1, "y": 2, "width": 4, "height": 4})
    assert (f[1]["value"], f[1]["is_checked"], f[1]["page"]) == ("x, y", None, 0) and r["document"][0]["has_xfa"]
    assert Keyword("x") == "x"


def test_strings_at_once_are_their_codes_one_by_one():
    from vellum.kernel.fonts import Font
    from vellum.kernel.objects import Name

    rnd = random.Random(3)
    simple = {"Subtype": Name("Type1"), "Encoding": {"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [128, Name("eacute"), Name("nothing"), Name("fi"), Name("uni00410042")]}}
    kinds = [simple, simple | {"FirstChar": 32, "Widths": [250, 333.3, 0, 408]}, {"FontDescriptor": {"Flags": 4}}, {"Subtype": Name("Type0"), "DescendantFonts": [{"DW": 700, "W": [65, [500.1, 600], 300, 400, 250]}]}]
    for d in kinds:
        f = Font(d, lambda x: x, lambda x: x)
        for size, char, word, scale in ((12.0, 0.0, 0.0, 1.0), (11.3, 0.0, 2.0, 0.9), (9.0, 0.1, 0.0, 1.0), (10.5, 1.0, 3.0, 1.0)):
            data = bytes(rnd.choices(range(256), k=rnd.randint(0, 90)))
            codes = f.codes(data)
            each = [f._one(c) for c in codes]
            assert f.text(codes) == ("".join(t for t, *_ in each), sum(x[3] == 1 for x in each), sum(x[3] == 2 for x in each))
            at = 7.25
            for _, width, blank, _ in each:
                at += (width / 1000 * size + char + (word if blank else 0.0)) * scale
            assert f.advance(7.25, codes, size, char, word, scale) == at


def test_texts_are_read_only_where_runs_are_wanted(monkeypatch):
    from vellum.kernel import fonts

    data = text_pdf("Some words\n" * 60, image=True, ruled=True, field="v")
    whole = analyze(data)

    def read(*_):
        raise AssertionError("a text was read")

    monkeypatch.setattr(fonts.Font, "text", read)
    for facets in (("document", "field"), ("field",), ("page", "image")):
        part = analyze(data, facets=facets)
        assert all(part[k] == whole[k] and whole[k] for k in facets)


def test_many_blocks_and_usual_tables():
    for n in (16, 32):
        key, data = bytes(range(n)), bytes(i * 7 & 255 for i in range(1_600))
        assert crypto.aes_cbc_decrypt(key, key[:16], crypto.aes_cbc_encrypt(key, key[:16], data)) == data
    assert crypto.user_entry(b"abcde", b"", 2) == crypto.rc4(b"abcde", crypto.PAD)
    made = text_pdf("Hello")
    odd = made.replace(b"0000000000 65535 f \n", b"0000000000 65535 f\t\n")  # not as tables are written mostly
    assert analyze(made)["run"] == analyze(odd)["run"] and analyze(made)["run"][0]["text"] == "Hello"
