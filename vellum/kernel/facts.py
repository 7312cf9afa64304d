"""One document's bytes to facts: a single pass that every facet shares."""

from __future__ import annotations

from vellum.kernel import forms
from vellum.kernel.content import RUN_ROW, Interpreter
from vellum.kernel.file import File
from vellum.kernel.filters import SHORT
from vellum.kernel.objects import Name, PdfError, Stream

ALL = ("document", "page", "run", "image", "field", "xobject", "raster")


def content_of(file: File, page) -> bytes:
    """The page's content streams, joined; a stream that can't be read makes the page empty."""
    c = file.resolve(page.dict.get("Contents"))
    parts = [file.resolve(x) for x in c] if isinstance(c, list) else [c]
    return b"\n".join(file.decoded(s) for s in parts if isinstance(s, Stream))


def color_space(file: File, d: dict, resources: dict) -> tuple[str | None, int]:
    """(family, components) of an image, without its palette or functions."""
    if file.resolve(d.get("ImageMask")) is True:
        return "ImageMask", 1
    x = d.get("ColorSpace", d.get("CS"))
    plain = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}
    for _ in range(9):
        x = file.resolve(x)
        if isinstance(x, Name):
            if x in plain:
                return {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[plain[x]], plain[x]
            if x == "Pattern":
                return "Pattern", 0
            named = file.resolve(resources.get("ColorSpace"))
            if not isinstance(named, dict) or named.get(str(x)) is None:
                return str(x), 0
            x = named[str(x)]
            continue
        if not isinstance(x, list) or not x:
            return None, 0
        family = str(file.resolve(x[0]))
        if family == "ICCBased":
            s = file.resolve(x[1]) if len(x) > 1 else None
            n = file.resolve(s.dict.get("N")) if isinstance(s, Stream) else 0
            return family, int(n) if isinstance(n, (int, float)) else 0
        if family == "DeviceN":
            names = file.resolve(x[1]) if len(x) > 1 else None
            return family, len(names) if isinstance(names, list) else 0
        return family, {"CalGray": 1, "Separation": 1, "Indexed": 1, "I": 1, "CalRGB": 3, "Lab": 3}.get(family, plain.get(family, 0))
    return None, 0


def _filters(file: File, d: dict) -> list[str]:
    n = file.resolve(d.get("Filter", d.get("F")))
    return [SHORT.get(str(x), str(x)) for v in (n if isinstance(n, list) else [n]) if isinstance(x := file.resolve(v), Name)]


def _int(file: File, d: dict, *keys: str) -> int:
    for k in keys:
        if isinstance(v := file.resolve(d.get(k)), (int, float)) and not isinstance(v, bool):
            return int(v)
    return 0


def raster(file: File, s: Stream, resources: dict) -> tuple[int, int, int, bytes]:
    """(width, height, components, samples) of an image in its own colour space, as gray or RGB. The space
    counts only where its components are those that the codec gives."""
    from vellum.kernel import ccitt, color, jbig2, jpeg, jpx

    codec, parms, data = file.image_data(s)
    w, h, bits = _int(file, s.dict, "Width", "W"), _int(file, s.dict, "Height", "H"), _int(file, s.dict, "BitsPerComponent", "BPC") or 8
    decode = file.resolve(s.dict.get("Decode"))
    decode = [float(file.resolve(v)) for v in decode] if isinstance(decode, list) else None
    mask = file.resolve(s.dict.get("ImageMask")) is True
    space = None
    if not mask and (x := s.dict.get("ColorSpace", s.dict.get("CS"))) is not None:
        space = color.resolve(file, x, resources)
    if codec == "DCTDecode":
        w, h, n, data = jpeg.decode(data, keep_cmyk=space is not None)
        if space is None or space.components != n:
            return (w, h, n, data) if n < 4 else (w, h, *color.to_rgb(data, w, h, n, 8, color.Space("DeviceCMYK", 4)))
        return w, h, *color.to_rgb(data, w, h, n, 8, space, decode)
    if codec == "CCITTFaxDecode":
        w, h, data = ccitt.decode(data, _int(file, parms, "K"), _int(file, parms, "Columns") or w or 1728, 0, parms.get("BlackIs1") is True, parms.get("EncodedByteAlign") is True)
        bits = 1
    elif codec == "JBIG2Decode":
        g = parms.get("JBIG2Globals")
        w, h, data, missing = jbig2.decode_page(data, file.decoded(g) if isinstance(g, Stream) else None)
        if missing:
            raise PdfError("JBIG2: " + "; ".join(missing))
        data, bits = bytes(255 - b for b in data), 1
    elif codec == "JPXDecode":
        w, h, n, data = jpx.decode(data)
        if space is None or space.components != n:
            return w, h, *jpx.plain(n, data)
        bits = 8
    elif codec:
        raise PdfError(f"unsupported image codec {codec}")
    if mask or space is None:
        space, bits = color.Space("DeviceGray", 1), 1 if mask else bits
    return w, h, *color.to_rgb(data, w, h, space.components, bits, space, decode)


def analyze(data: bytes, password: str | None = None, facets: tuple[str, ...] = ALL[:-1]) -> dict[str, list[dict]]:
    """Facts by kind. Only PdfError marks a document as rejected, with its message; any other error is a
    malformed object. The caller never sees an exception."""
    out: dict[str, list[dict]] = {k: [] for k in ALL}
    head = {"page_count": 0, "error": None, "is_encrypted": False, "handler_supported": True, "algorithm": "None", "revision": 0, "authentication": "NotRequired", "metadata_encrypted": False, "permissions": 0, "has_acro_form": False, "has_xfa": False}
    try:
        _facts(data, password, facets, out, head)
    except PdfError as e:
        out = {k: [] for k in ALL}
        head |= {"page_count": 0, "error": str(e), "is_encrypted": False, "algorithm": "None", "revision": 0, "authentication": "NotRequired", "permissions": 0, "metadata_encrypted": False, "has_acro_form": False, "has_xfa": False}
    except Exception as e:  # noqa: BLE001 - whatever a hostile file brings about is that file's own row
        out = {k: [] for k in ALL}
        head |= {"page_count": 0, "error": f"malformed object: {type(e).__name__}"}
    out["document"] = [head]
    return out


def _facts(data: bytes, password: str | None, facets: tuple[str, ...], out: dict[str, list[dict]], head: dict) -> None:
    file = File(data, password)
    if file.encrypt_ref is not None or isinstance(file.trailer.get("Encrypt"), dict):
        head["is_encrypted"], head["handler_supported"] = True, file.handler_supported
        if h := file.handler:
            if h.key is None:
                raise PdfError("a password is required or the one given is wrong: the document can't be decrypted")
            head |= {"algorithm": h.algorithm, "revision": h.revision, "authentication": h.authentication, "metadata_encrypted": h.metadata, "permissions": h.permissions}
    pages = file.pages()
    head["page_count"] = len(pages)
    walk = {"run", "image", "page"} & set(facets)
    interpreter = Interpreter(file, "run" in facets)
    for p in pages:
        box = p.box
        row = {"page": p.index, "width": box[2] - box[0], "height": box[3] - box[1], "rotation": p.rotation, "ruling_line_count": 0, "font_distinct_count": 0}
        out["page"].append(row)
        if walk:
            try:
                r = interpreter.run(content_of(file, p), p.resources)
            except (PdfError, ValueError, KeyError, IndexError, TypeError, OverflowError, RecursionError):
                r = None
            if r is not None:
                row |= {"ruling_line_count": r.rulings, "font_distinct_count": len(r.fonts)}
                if "run" in facets:
                    out["run"] += [dict(zip(RUN_ROW, (i, p.index, *x, x.render_mode == 3))) for i, x in enumerate(r.runs, len(out["run"]))]
                if "image" in facets:
                    for x in r.images:
                        d = x.stream.dict
                        a, b, c, e, f, g = x.matrix
                        out["image"].append({"ord": len(out["image"]), "page": p.index, "name": x.name, "px_w": _int(file, d, "Width", "W"), "px_h": _int(file, d, "Height", "H"), "a": a, "b": b, "c": c, "d": e, "e": f, "f": g, "filters": _filters(file, d), "has_smask": isinstance(file.resolve(d.get("SMask")), Stream), "has_mask": file.resolve(d.get("Mask")) is not None, "is_image_mask": file.resolve(d.get("ImageMask")) is True})
        if {"xobject", "raster"} & set(facets):
            objects = file.resolve(p.resources.get("XObject"))
            for name, ref in objects.items() if isinstance(objects, dict) else ():
                s = file.resolve(ref)
                if isinstance(s, Stream) and file.resolve(s.dict.get("Subtype")) == "Image":
                    if "raster" in facets:
                        row = {"ord": len(out["raster"]), "page": p.index, "name": name, "width": 0, "height": 0, "components": 0, "samples": None, "error": None}
                        try:
                            row |= dict(zip(("width", "height", "components", "samples"), raster(file, s, p.resources)))
                        except (PdfError, ValueError, IndexError, KeyError, TypeError, OverflowError) as e:
                            row["error"] = str(e) or type(e).__name__
                        out["raster"].append(row)
                    if "xobject" not in facets:
                        continue
                    family, n = color_space(file, s.dict, p.resources)
                    codec, parms, raw = None, {}, b""
                    try:
                        codec, parms, raw = file.image_data(s)
                    except PdfError:
                        raw = s.raw
                    decode = file.resolve(s.dict.get("Decode"))
                    globals_ = parms.get("JBIG2Globals")
                    out["xobject"].append({"ord": len(out["xobject"]), "page": p.index, "name": name, "px_w": _int(file, s.dict, "Width", "W"), "px_h": _int(file, s.dict, "Height", "H"), "bits": _int(file, s.dict, "BitsPerComponent", "BPC"), "filters": _filters(file, s.dict), "codec": codec, "family": family, "components": n, "decode": [float(file.resolve(v)) for v in decode] if isinstance(decode, list) and all(isinstance(file.resolve(v), (int, float)) for v in decode) else None, "has_smask": isinstance(file.resolve(s.dict.get("SMask")), Stream), "k": _int(file, parms, "K"), "columns": _int(file, parms, "Columns") or _int(file, s.dict, "Width", "W") or 1728, "black_is_1": parms.get("BlackIs1") is True, "byte_align": parms.get("EncodedByteAlign") is True, "globals": file.decoded(globals_) if isinstance(globals_, Stream) else None, "data": raw})
    if "field" in facets:
        head["has_acro_form"], head["has_xfa"], found = forms.fields(file, pages)
        out["field"] = [{"ord": i, **f._asdict(), "rect": dict(zip(("x", "y", "width", "height"), f.rect)) if f.rect else None} for i, f in enumerate(found)]
