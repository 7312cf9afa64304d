"""AcroForm fields."""

from __future__ import annotations

from typing import NamedTuple

from vellum.kernel.objects import Name, Ref

DEPTH = 50


class Field(NamedTuple):
    fqn: str
    partial: str | None
    label: str | None
    field_type: str
    value: str | None
    is_checked: bool | None
    page: int | None
    rect: tuple[float, float, float, float] | None


def text(x) -> str | None:
    if not isinstance(x, bytes):
        return None
    return x[2:].decode("utf-16-be", "replace") if x[:2] == b"\xfe\xff" else x.decode("latin-1")


def show_number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def shown(file, x) -> str | None:
    """A field's value as text; of an array its strings; null if it says nothing."""
    x = file.resolve(x)
    if isinstance(x, bytes):
        return text(x)
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Name):
        return str(x)
    if isinstance(x, (int, float)):
        return show_number(x)
    if isinstance(x, list):
        return ", ".join(t for v in x if (t := text(file.resolve(v))) is not None) or None if any(isinstance(file.resolve(v), bytes) for v in x) else None
    return None


def fields(file, pages) -> tuple[bool, bool, list[Field]]:
    """(has a form, has XFA, its fields)."""
    form = file.resolve(file.catalog().get("AcroForm"))
    if not isinstance(form, dict):
        return False, False, []
    on: dict[int, int] = {}
    for p in pages:
        annots = file.resolve(p.dict.get("Annots"))
        for a in annots if isinstance(annots, list) else []:
            if isinstance(a, Ref):
                on.setdefault(a.number, p.index)
    out: list[Field] = []

    def rect(d: dict) -> tuple[float, float, float, float] | None:
        r = file.resolve(d.get("Rect"))
        if not isinstance(r, list) or len(r) < 4:
            return None
        a, b, c, e = (float(v) if isinstance(v := file.resolve(k), (int, float)) else 0.0 for k in r[:4])
        return min(a, c), min(b, e), abs(c - a), abs(e - b)

    def walk(node, parent: str, kind, value, depth: int) -> None:
        d = file.resolve(node)
        if depth > DEPTH or not isinstance(d, dict):
            return
        own = text(file.resolve(d.get("T")))
        name = f"{parent}.{own}" if parent and own else own or parent
        ft = file.resolve(d.get("FT"))
        kind = ft if isinstance(ft, Name) else kind
        value = d["V"] if d.get("V") is not None else value
        kids = file.resolve(d.get("Kids"))
        kids = kids if isinstance(kids, list) else []
        inner = [k for k in kids if isinstance(x := file.resolve(k), dict)]
        if any("T" in file.resolve(k) for k in inner):
            for k in kids:
                walk(k, name, kind, value, depth + 1)
            return
        numbers = [k.number for k in [node, *kids] if isinstance(k, Ref)]
        page = next((on[n] for n in numbers if n in on), None)
        box = rect(d) or next((r for k in inner if (r := rect(file.resolve(k)))), None)
        checked = None
        if kind == "Btn":
            v, state = file.resolve(value), file.resolve(d.get("AS"))
            said = str(v) if isinstance(v, Name) else str(state) if isinstance(state, Name) else None
            checked = said is not None and said != "Off"
        else:
            said = shown(file, value)
        out.append(Field(name, own, text(file.resolve(d.get("TU"))), str(kind or ""), said, checked, page, box))

    roots = file.resolve(form.get("Fields"))
    for r in roots if isinstance(roots, list) else []:
        walk(r, "", None, None, 0)
    return True, "XFA" in form, out
