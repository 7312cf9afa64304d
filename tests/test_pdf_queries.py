"""Queries over files ask the kernel for the kinds of facts that they are about, and write no table to read it once."""

import pytest

from vellum.plans import pdf_queries, queries


class Asked(Exception):
    pass


@pytest.mark.parametrize("name,written,facets", [
    ("pdf_form_fields", False, {"field"}), ("pdf_security", False, {"document"}), ("pdf_plain_text", False, {"run"}), ("pdf_page_facts", True, {"page", "run"}),
    ("pdf_decode_trust", True, {"page", "run"}), ("pdf_image_resolution", True, {"page", "image"}), ("pdf_page_classes", True, {"page", "run", "image", "field"}),
    ("pdf_coverage_records", True, {"document", "page", "run", "image", "field"}), ("pdf_outcomes", True, {"document", "page", "run", "image", "field"}),
])
def test_facets(spark, sf_dir, monkeypatch, name, written, facets):
    def asked(kind):
        def f(binary, *_, facets=(), **__):
            raise Asked(kind, set(facets))

        return f

    monkeypatch.setattr(pdf_queries, "Facts", asked(True))
    monkeypatch.setattr(pdf_queries, "facts", asked(False), raising=False)
    with pytest.raises(Asked) as e:
        queries.QUERIES[name](spark, sf_dir)
    assert e.value.args == (written, facets)
