"""Scalar rules as Catalyst expressions: rounding, strings, rectangles, names, gates and edit distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding to the even neighbour at a tie."""
    return F.bround(c, digits)


def away(c: Column, digits: int = 0) -> Column:
    """Rounding away from zero at a tie."""
    return F.round(c, digits)


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to one place, half-even; 0 where there is no whole."""
    return F.when(whole > 0, half_even(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1)).otherwise(F.lit(0.0))


def utf16_length(c: Column) -> Column:
    """Number of UTF-16 units of a string."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def pdf_text(c: Column) -> Column:
    """Text of a PDF string's bytes: UTF-16BE behind its byte-order mark, else one character a byte."""
    marked = F.hex(F.substring(c, 1, 2)) == "FEFF"
    return F.when(marked, F.decode(F.substring(c, F.lit(3), F.length(c)), "UTF-16BE")).otherwise(F.decode(c, "ISO-8859-1"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """(x, y, width, height) of two corners in any order."""
    return F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("width"), F.abs(y1 - y0).alias("height"))


def rotation(c: Column) -> Column:
    return F.pmod(c, F.lit(360))


def qualified_name(parent: Column, own: Column) -> Column:
    """Dotted name; an empty or missing part leaves no dot."""
    p, o = F.coalesce(parent, F.lit("")), F.coalesce(own, F.lit(""))
    return F.when(p == "", o).when(o == "", p).otherwise(F.concat(p, F.lit("."), o))


ALGORITHM_NAMES = {"None": "None", "Rc4": "RC4", "Aes128": "AES-128", "Aes256": "AES-256", "Unknown": "Unknown"}


def algorithm_name(c: Column) -> Column:
    """The name of an encryption algorithm as records show it."""
    out = None
    for k, v in ALGORITHM_NAMES.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(c)


def preflight(content: Column, length: Column | None = None, head: str = "%PDF-", tail: str = "%%EOF") -> Column:
    """Null for bytes that may be a document, else why they can't: no mark in the first 1024 bytes, or none at
    the end, in the last 2048. It runs below the byte kernel, so what fails never leaves the JVM."""
    n = F.length(content) if length is None else length
    start = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    end = F.decode(F.when(n > 2048, F.substring(content, F.greatest(n - 2047, F.lit(1)).cast("int"), F.lit(2048))).otherwise(content), "ISO-8859-1")
    return F.when((n < 5) | ~start.contains(head), "MissingHeader").when(~end.contains(tail), "MissingEof")


REASONS = [
    ("EncryptedPasswordRequired", ("password", "authentication")), ("EncryptionUnsupported", ("encrypt", "decrypt")),
    ("XrefUnresolvable", ("startxref", "xref", "trailer")), ("CatalogUnreachable", ("catalog", "page tree", "/root", "/pages")),
    ("TruncatedStream", ("endstream", "truncat", "end of input")),
]


def rejection_reason(message: Column) -> Column:
    """The class of a parser's message: the first rule of which it has a word."""
    low, out = F.lower(message), None
    for reason, words in REASONS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out.otherwise("MalformedObject")


def console(c: Column, width: int = 100) -> Column:
    """One line for a console: control characters are blanks, what is too long ends in an ellipsis."""
    clean = F.regexp_replace(c, r"\p{Cntrl}", " ")
    return F.when(F.length(clean) > width, F.concat(F.substring(clean, 1, width), F.lit("…"))).otherwise(clean)


def has_meaning(c: Column) -> Column:
    """Whether a text has any character besides controls and the replacement character."""
    return F.coalesce(c, F.lit("")).rlike("[^\\x00-\\x1F\\uFFFD]")


def tokens(c: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def char_distance(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit("")))


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of words: each distinct word of the pair becomes one character of a private alphabet,
    then it is the distance of strings. The alphabet is the supplementary planes, 1,048,576 characters; a pair of
    more distinct words gives null."""

    def let(value: Column, body) -> Column:
        """``body`` of a value that is worked out once a row, also where lambdas read it."""
        return F.transform(F.array(value), body)[0]

    def coded(words: Column, vocabulary: Column) -> Column:
        codes = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + F.lit(0xFFFF)), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    def distance(p: Column, v: Column) -> Column:
        return F.when(F.size(v) <= 1 << 20, F.levenshtein(coded(p["r"], v), coded(p["h"], v)))

    both = F.struct(tokens(reference).alias("r"), tokens(hypothesis).alias("h"))
    return let(both, lambda p: let(F.array_distinct(F.concat(p["r"], p["h"])), lambda v: distance(p, v)))


def rate(distance: Column, length: Column) -> Column:
    """Errors by length; of an empty reference 0 if nothing was read, else 1."""
    return F.when(length == 0, F.when(distance == 0, 0.0).otherwise(1.0)).otherwise(distance / F.nullif(length, F.lit(0)))


def cer(reference: Column, hypothesis: Column) -> Column:
    return rate(char_distance(reference, hypothesis), F.length(F.coalesce(reference, F.lit(""))))


def wer(reference: Column, hypothesis: Column) -> Column:
    return rate(word_distance(reference, hypothesis), F.size(tokens(reference)))
