"""Byte-level BPE over whole texts: exact, with one dictionary look-up a pre-token.

The pre-token pattern and the ranks are the vocabulary file's; a pre-token is encoded once by tiktoken and
kept, so a text costs one pattern scan and one look-up for each pre-token.
"""

from __future__ import annotations

import base64
import re
import sys
from functools import cache

import numpy as np

#: The pre-token rule of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker keeps, the first it meets: frequent words come early.
KEPT = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _patterns() -> tuple[re.Pattern, object]:
    """The pattern for texts within the basic plane, in ``re`` with explicit classes, and for all texts."""
    import regex

    def ranges(cls: str) -> str:
        out, begin = [], None
        member = regex.compile(cls).match
        for c in range(0x10001):
            inside = c < 0x10000 and not 0xD800 <= c < 0xE000 and member(chr(c)) is not None
            if inside and begin is None:
                begin = c
            elif not inside and begin is not None:
                out.append(f"\\u{begin:04x}" + (f"-\\u{c - 1:04x}" if c - 1 > begin else ""))
                begin = None
        return "".join(out)

    letters, numbers, spaces = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    plane = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    return re.compile(plane), regex.compile(PATTERN)


class Words(dict):
    """Pre-token -> its ids, as bytes of little-endian uint32."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), np.uint32).tobytes()
        if len(self) < KEPT and len(word) < 64:
            self[word] = ids
        return ids


@cache
def words(path: str) -> Words:
    return Words(path)


#: What keeps tables between tasks.
KEEPERS = (encoding, _patterns, words)


def pretokens(text: str) -> list[str]:
    plane, every = _patterns()
    return (plane if text.isascii() or max(text) < "\U00010000" else every).findall(text)


def encode(text: str, path: str) -> np.ndarray:
    """The ids of a text, as uint32."""
    return np.frombuffer(b"".join(map(words(path).__getitem__, pretokens(text))), np.uint32)


def decode(ids: np.ndarray, path: str) -> str:
    return encoding(path).decode_bytes(ids.tolist()).decode("utf-8", "replace")


assert sys.byteorder == "little"
