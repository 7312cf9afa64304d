"""Secret scan by token efficiency.

Text that people write compresses well under a byte-pair vocabulary; random strings don't: they take a
token for every one or two characters. Candidates are whole runs of key characters, and where a run is no
secret, its parts of MIN_LENGTH or more: from where an issued key begins, then between separators. Those of
few characters a token are secrets, unless they are known digests or identifiers:

* digests: runs of exactly 32, 40, 56, 64, 96 or 128 hexadecimal digits, unless a credential's name and
  ``=`` or ``:`` stand before them; and whatever is in ``known_digests``, wherever it stands;
* identifiers: UUIDs, plain numbers and dates, names put together from words (snake, kebab or camel case),
  and runs beside an ``@`` (mail addresses), unless an issued key begins in them or they are a link's user or
  password, which are measured like any other run;
* embedded data: runs in a data URI, runs of more than MAX_LENGTH, and lines of base64 (whole lines of 60 or more,
  beside another as long), such as certificates and attachments, unless they stand in a PEM block of a private key.

A run has MIN_LENGTH characters at least; one of letters and digits that stands right behind a credential's name
and ``=`` or ``:`` has MIN_NAMED. Shorter ones are not looked at.

Defined results: null and empty texts have no rows; a string that occurs again is reported at each place;
repeated input rows give repeated results; texts of any length are scanned whole; ``start`` counts code
points from 0. Other columns of the input are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import bpe
from vellum.session import ship, tidy

MIN_LENGTH = 16
MIN_NAMED = 12
MAX_LENGTH = 1024
#: Characters a token; below, a run is random. Runs of letters alone have to lie below the second bound,
#: but for those that begin as issued keys do or stand behind a credential's name.
MAX_RATIO = 2.4
MAX_RATIO_LETTERS = 1.5
SCHEMA = "doc_id long, start long, length long, secret string, n_tokens long, chars_per_token double"
#: Digests that stand in many texts: of the empty input.
KNOWN = frozenset(getattr(hashlib, h)(b"").hexdigest() for h in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))

_RUN = re.compile(r"(?<![\w+/\-])[A-Za-z0-9+/_\-]{%d,}={0,2}(?!\w)" % MIN_NAMED, re.A)
_CREDENTIAL = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|authorization|bearer|credentials?|signature)[\"']?\s*(?:[=:]|:=|=>|\s)\s*[\"']?$", re.I)
#: How issued keys begin, at the begin of a run or behind a separator in it.
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA|AIza|gh[pousr]_|github_pat_|sk_live_|sk-|xox[abprs]-|glpat-|npm_|eyJ)")
#: What stands before and after the user or password of a link.
_LINK = re.compile(r"://[^\s/?#\"'<>]*(?::[^\s?#\"'<>]*)?$")
_USER = re.compile(r"@|:[^\s/@]*@")
#: A credential's name with its sign, as it stands before a short key.
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?\s*[=:]\s*[\"']?$", re.I)
_SHORT = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9]+")
_DATA = re.compile(r"data:[\w.+/-]*(?:;[\w.=+-]+)*;base64,$", re.I)
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)-----")
_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}\r?(?=\n|\Z)")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGESTS = {32, 40, 56, 64, 96, 128}
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|\d{1,4}|[A-Za-z]")


def _identifier(run: str) -> bool:
    """A number, a UUID or a name made of words: after separators and changes of case, words are letters
    alone and there are no more than two short numbers."""
    if _UUID.fullmatch(run) or not re.search(r"[A-Za-z]", run):
        return True
    if not re.search(r"[_\-/]|[a-z][A-Z]", run):
        return False
    parts = re.split(r"[_\-/+=]+", run)
    if any(p and not re.fullmatch(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]+)*\d{0,4}|\d{1,8}", p) for p in parts):
        return False
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", run)
    return bool(words) and sum(map(len, words)) / len(words) >= 2.5


def _tokens(run: str, before: str, path: str, ratio: float, letters: float) -> int:
    """The tokens of a secret, 0 for another run."""
    if _identifier(run):
        return 0
    named = _CREDENTIAL.search(before)
    if len(run) in _DIGESTS and _HEX.fullmatch(run) and not named:
        return 0
    n = len(bpe.encode(run, path))
    plain = run.isalpha() and not _ISSUED.match(run) and not named
    return n if len(run) < (letters if plain else ratio) * n else 0


def _pieces(run: str) -> list[tuple[int, str]]:
    """(offset, piece): cut where issued keys begin, else at the first kind of separator there is."""
    if cuts := [m.start() for m in _ISSUED.finditer(run) if m.start()]:
        return [(i, run[i : j - 1] if j else run[i:]) for i, j in zip([0, *cuts], [*cuts, None])]
    out, at = [], 0
    for x in run.split(next((c for c in "/+-_" if c in run[:-1]), "\0")):
        out.append((at, x))
        at += len(x) + 1
    return out if len(out) > 1 else []


def _embedded(text: str, start: int, end: int, private: list[tuple[int, int]]) -> bool:
    """Whether the run is data that the text carries rather than a key."""
    if _DATA.search(text[max(0, start - 100) : start]):
        return True
    # In a PEM block: a private key's lines are secrets.
    at = bisect_right(private, (start, len(text))) - 1
    if at >= 0 and start < private[at][1]:
        return False
    if end - start > MAX_LENGTH:
        return True
    if end - start < 60 or (start and text[start - 1] != "\n") or text[end : end + 2].lstrip("\r")[:1] not in ("\n", ""):
        return False
    above = text[text.rfind("\n", max(0, start - 1 - MAX_LENGTH), start - 1) + 1 : start - 1].rstrip("\r") if start else ""
    below = m.group().rstrip("\r") if (m := _LINE.match(text, text.find("\n", end) + 1 or len(text))) else ""
    return len(below) == end - start or (len(above) >= end - start and _LINE.fullmatch(above) is not None)


def _private(text: str) -> list[tuple[int, int]]:
    """(start, end) of the PEM blocks of private keys."""
    out, begin = [], None
    for m in _PEM.finditer(text) if "-----" in text else ():
        if begin is not None:
            out.append((begin, m.start()))
        begin = m.end() if m.group(1) == "BEGIN" and "PRIVATE KEY" in m.group(2) else None
    return out if begin is None else [*out, (begin, len(text))]


def find(text: str, path: str, known: frozenset[str] = KNOWN, ratio: float = MAX_RATIO, letters: float = MAX_RATIO_LETTERS) -> list[tuple[int, str, int]]:
    """(start, secret, tokens) of every secret of a text."""
    out = []
    private = _private(text)
    for m in _RUN.finditer(text):
        run, start = m.group(), m.start()
        if len(run) < MIN_LENGTH:
            if _SHORT.fullmatch(run) and run not in known and _NAMED.search(text[max(0, start - 40) : start]) and (n := _tokens(run, "", path, ratio, letters)):
                out.append((start, run, n))
            continue
        if _embedded(text, start, m.end(), private):
            continue
        user = text[m.end() : m.end() + 1] == "@" and _LINK.search(text[max(0, start - 300) : start])
        if run.startswith("//") and text[start - 1 : start] == ":" and _USER.match(text, m.end()):
            run, start, user = run[2:], start + 2, True
        if not user and "@" in (text[start - 1 : start], text[m.end() : m.end() + 1]) and not _ISSUED.search(run):
            continue
        todo = [(start, run)]
        while todo:
            at, x = todo.pop()
            if len(x) < MIN_LENGTH or x in known or x.lower() in known:
                continue
            if n := _tokens(x, text[max(0, at - 40) : at], path, ratio, letters):
                out.append((at, x, n))
            else:
                todo += [(at + i, y) for i, y in reversed(_pieces(x))]
    return out


def scan(docs: DataFrame, path: str | None = None, known_digests: frozenset[str] = frozenset()) -> DataFrame:
    """One row for each secret of each document. A narrow pass: nothing is shuffled or broadcast."""
    path = path or bpe.vocabulary_path()
    known = KNOWN | known_digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, s, len(x), x, n, len(x) / n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) if t.is_valid for s, x, n in find(t.as_py(), path, known)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _types)], _names)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(run, *bpe.KEEPERS), SCHEMA)


_names = ["doc_id", "start", "length", "secret", "n_tokens", "chars_per_token"]
_types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()]


def redact(docs: DataFrame, path: str | None = None, mark: str = "[SECRET]", known_digests: frozenset[str] = frozenset()) -> DataFrame:
    """All documents with all their columns; each secret in ``text`` gives way to ``mark`` and ``n_chars``,
    where there is one, follows. A null text stays null."""
    path = path or bpe.vocabulary_path()
    known = KNOWN | known_digests
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None or not (found := find(text, path, known)):
            return text
        out, last = [], 0
        for start, x, _ in found:
            out += [text[last:start], mark]
            last = start + len(x)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    ship(docs.sparkSession)
    out = docs.mapInArrow(tidy(run, *bpe.KEEPERS), docs.schema)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").contains(mark), changed).otherwise(F.col("n_chars")))
    return out
