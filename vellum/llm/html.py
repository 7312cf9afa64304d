"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in document order, each with the path
of tags above it. A block's input is a hashed vector of its tag path, a hashed vector of its words, and its
length, link share, punctuation and place. A bidirectional LSTM (numpy) reads the sequence, so that each
block is labelled with the whole document in view; blocks labelled as content make up the text.

Training: pages that mark their content by <article> or <main> and their rest by <nav>, <footer>, <aside>,
<header> or a class such as "ad" or "menu" label their own blocks. At most ``SAMPLE`` pages, those with the
least hash of a page_id that is not null, train; on half of the passes these telling elements are hidden from the input, so
that the words, shapes and neighbours have to tell. Without any such page, all blocks count as content.

Defined results: a null page has a null text, an empty one an empty text, both 0 blocks; broken, unclosed
and cut-off markup is read as far as it goes; scripts, styles, comments, templates and titles are no blocks;
repeated rows give equal rows; pages of any length are read whole. Other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.text_kernel import mix, word_hashes
from vellum.session import least_by_hash, ship

SAMPLE = 300
HIDDEN = 16
PATH, WORDS, SHAPE = 24, 16, 6
WIDTH = PATH + WORDS + SHAPE
EPOCHS = 12
SCHEMA = "page_id long, text string, n_blocks int, n_content int"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|([^<]+|<)", re.S | re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([\w\- ]+)", re.I)
_CONTENT = frozenset(["article", "main", ".article", ".main", ".content"])
_REST = frozenset(["nav", "footer", "aside", "header", "form", ".ad", ".ads", ".menu", ".nav", ".footer", ".sidebar", ".navigation", ".banner", ".cookie"])
_TELLING = _CONTENT | _REST
_SPACE = re.compile(r"\s+")
_rng = np.random.RandomState(11)
_PATH = _rng.normal(0, 1, (4096, PATH)).astype(np.float32)
_WORD = _rng.normal(0, 1, (4096, WORDS)).astype(np.float32)


@lru_cache(50_000)
def _hashed(names: tuple[str, ...]) -> np.ndarray:
    """Sum of the names' vectors."""
    if not names:
        return np.zeros(PATH, np.float32)
    codes = np.array([int.from_bytes(n.encode()[:8], "little") + 131 * len(n) + sum(n.encode()) * 65_537 for n in names], np.uint64)
    return _PATH[(mix(codes) & np.uint64(4095)).astype(np.int64)].sum(0)


@lru_cache(4096)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    m = _CLASS.findall(attributes) if "=" in attributes else ()
    return (tag, *(f".{c}" for x in m for c in x.lower().split()))


class Path:
    """The block-level elements above a block, as a node of a tree of paths: a step down costs the same however deep
    it is, and pages of like build share nodes. ``label`` is what the innermost telling element says."""

    __slots__ = ("parent", "names", "steps", "label", "sums", "counts", "lasts", "_vectors")
    made = 0

    def __init__(self, parent: Path | None, names: tuple[str, ...]):
        self.parent, self.names, self.steps = parent, names, {}
        self.label: int | None = parent.label if parent else None
        for name in names:
            self.label = 1 if name in _CONTENT else 0 if name in _REST else self.label
        # All names, and those that don't tell: sum of their vectors, how many, and the last three.
        self.sums, self.counts, self.lasts = [], [], []
        self._vectors: list[np.ndarray | None] = [None, None]
        for k, own in enumerate((names, tuple(n for n in names if n not in _TELLING))):
            above = (parent.sums[k], parent.counts[k], parent.lasts[k]) if parent else (np.zeros(PATH, np.float32), 0, ())
            self.sums.append(above[0] + _hashed(own) if own else above[0])
            self.counts.append(above[1] + len(own))
            self.lasts.append((*above[2], *own)[-3:])

    def step(self, names: tuple[str, ...]) -> Path:
        if (node := self.steps.get(names)) is None:
            node = self.steps[names] = Path(self, names)
            Path.made += 1
        return node

    def vector(self, hidden: bool) -> np.ndarray:
        """Sum of the hashed vectors of the path's elements and of the last three with their place."""
        if self._vectors[hidden] is None:
            last = self.lasts[hidden]
            n = self.counts[hidden] + len(last)
            self._vectors[hidden] = (self.sums[hidden] + _hashed(tuple(f"{i}:{x}" for i, x in enumerate(reversed(last))))) / np.sqrt(n) if n else self.sums[hidden]
        return self._vectors[hidden]

    def path(self) -> tuple[str, ...]:
        out, node = [], self
        while node.parent is not None:
            out.append(node.names)
            node = node.parent
        return tuple(n for names in reversed(out) for n in names)


@dataclass
class Block:
    at: Path
    text: str
    link: float

    @property
    def path(self) -> tuple[str, ...]:
        return self.at.path()


#: Paths that a worker keeps between pages.
KEPT = 100_000
_root: list[Path] = []


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in time and memory that follow its length, however deep elements are nested."""
    if not _root or Path.made > KEPT:
        Path.made = 0
        _root[:] = [Path(None, ())]
    out: list[Block] = []
    # Open elements with their paths; how many of each block-level tag are open; and for each open block-level
    # element (and none) how many of each inline tag are open right above it.
    stack: list[tuple[str, Path]] = []
    opened: dict[str, int] = {}
    inline: list[dict[str, int]] = [{}]
    at = _root[0]
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        t = _SPACE.sub(" ", unescape("".join(text))).strip()
        if t:
            out.append(Block(at, t, min(1.0, linked / len(t))))
        text.clear()
        linked = 0

    def pop() -> str:
        nonlocal at
        tag, _ = stack.pop()
        if tag in _INLINE:
            inline[-1][tag] -= 1
        else:
            opened[tag] -= 1
            inline.pop()
        at = stack[-1][1] if stack else _root[0]
        return tag

    for m in _TOKEN.finditer(page):
        words = m.group(5)
        if words is not None:
            text.append(words)
            if links:
                linked += len(words)
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "a":
                links = max(0, links - 1)
            if tag not in _INLINE:
                flush()
            # An inline element is closed up to the next block-level one only.
            if (inline[-1] if tag in _INLINE else opened).get(tag):
                while pop() != tag:
                    pass
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag not in _INLINE:
            flush()
            links = 0
            while stack and stack[-1][0] in _INLINE:
                pop()
            closes = _CLOSES.get(tag)
            if closes and stack and stack[-1][0] in closes:
                pop()
        elif tag == "a":
            links += 1
        if tag not in _VOID and not m.group(4).endswith("/"):
            if tag in _INLINE:
                inline[-1][tag] = inline[-1].get(tag, 0) + 1
            else:
                opened[tag] = opened.get(tag, 0) + 1
                inline.append({})
                at = at.step(_names(tag, m.group(4)))
            stack.append((tag, at))
    flush()
    return out


def label(block: Block) -> int | None:
    """1 or 0 if the page says so itself: the innermost telling element counts."""
    return block.at.label


def features(pages: list[list[Block]], hide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(blocks x WIDTH, offsets of the pages)."""
    every = [b for p in pages for b in p]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    x = np.zeros((len(every), WIDTH), np.float32)
    if not every:
        return x, offsets
    hidden = np.repeat(hide, np.diff(offsets)).tolist() if hide is not None else [False] * len(every)
    for i, b in enumerate(every):
        x[i, :PATH] = b.at.vector(bool(hidden[i]))
    hashes, at = word_hashes(pa.array([b.text for b in every], pa.large_string()))
    n = np.diff(at)
    sums = np.concatenate([np.zeros((1, WORDS)), np.cumsum(_WORD[(hashes & np.uint64(4095)).astype(np.int64)], 0, dtype=np.float64)])
    x[:, PATH : PATH + WORDS] = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(n, 1))[:, None]
    place = np.arange(len(every)) - np.repeat(offsets[:-1], np.diff(offsets))
    size = np.repeat(np.diff(offsets), np.diff(offsets))
    length = np.array([len(b.text) for b in every])
    marks = np.array([b.text.count(".") + b.text.count(",") for b in every])
    x[:, PATH + WORDS :] = np.stack([np.log1p(length) / 3 - 1, np.log1p(n) / 2 - 1, [b.link for b in every], marks / np.maximum(n, 1), place / np.maximum(size, 1), 1 / (1 + place)], 1)
    return x, offsets


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """Bidirectional LSTM with a logistic output; W[d] maps [input, state, 1] to the four gates."""

    def __init__(self, seed: int = 3):
        r = np.random.RandomState(seed)
        self.W = [(r.normal(0, 1, (WIDTH + HIDDEN + 1, 4 * HIDDEN)) / np.sqrt(WIDTH + HIDDEN)).astype(np.float32) for _ in (0, 1)]
        for w in self.W:
            w[-1] = 0
            w[-1, HIDDEN : 2 * HIDDEN] = 1  # gates begin open: forget nothing
        self.out = (r.normal(0, 1, 2 * HIDDEN + 1) / np.sqrt(2 * HIDDEN)).astype(np.float32)

    def _pass(self, d: int, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; x is time x page x WIDTH. Where a page has ended the state stays."""
        T, B, _ = x.shape
        w, inner = self.W[d][:WIDTH], self.W[d][WIDTH : WIDTH + HIDDEN]
        pre = x.reshape(T * B, WIDTH) @ w + self.W[d][-1]
        pre = pre.reshape(T, B, 4 * HIDDEN)
        h = np.zeros((B, HIDDEN), np.float32)
        c = np.zeros((B, HIDDEN), np.float32)
        out = np.zeros((T, B, HIDDEN), np.float32)
        for t in range(T) if d == 0 else range(T - 1, -1, -1):
            z = pre[t] + h @ inner
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * u, c)
            th = np.tanh(c2)
            h2 = np.where(m, o * th, h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, th, m))
            h, c = h2, c2
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        both = [self._pass(d, x, mask, None if keep is None else keep[d]) for d in (0, 1)]
        states = np.concatenate(both, 2)
        if keep is not None:
            keep.append(states)
        return _sigmoid(states @ self.out[:-1] + self.out[-1])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        keep: list = [[], []]
        p = self.forward(x, mask, keep)
        dz = (p - y) * weight
        states = keep[2]
        g_out = np.append(np.einsum("tb,tbh->h", dz, states), dz.sum()).astype(np.float32)
        grads = []
        for d in (0, 1):
            dh_in = dz[:, :, None] * self.out[d * HIDDEN : (d + 1) * HIDDEN]
            gw = np.zeros_like(self.W[d])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            inner = self.W[d][WIDTH : WIDTH + HIDDEN]
            for t, h, c, i, f, o, u, th, m in reversed(keep[d]):
                dh = dh + dh_in[t]
                do, dc2 = dh * th, dc + dh * o * (1 - th * th)
                dzz = np.concatenate([dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - u * u)], 1) * m
                gw[:WIDTH] += x[t].T @ dzz
                gw[WIDTH:-1] += h.T @ dzz
                gw[-1] += dzz.sum(0)
                dh = np.where(m, dzz @ inner.T, dh)
                dc = np.where(m, dc2 * f, dc)
            grads.append(gw)
        return [*grads, g_out]

    def probabilities(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(content) of every block; pages of like length are done together."""
        out = np.zeros(len(x))
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end - begin + 1) * size[order[end]] <= 20_000:
                end += 1
            own = order[begin:end]
            xs, mask, at = pad(x, offsets, own)
            out[at[mask]] = self.forward(xs, mask)[mask]
            begin = end
        return out


def pad(x: np.ndarray, offsets: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time x page x WIDTH, mask, index of each block)."""
    size = np.diff(offsets)[pages]
    t = np.arange(size.max())[:, None]
    mask = t < size[None, :]
    at = np.where(mask, offsets[:-1][pages][None, :] + t, 0)
    return np.where(mask[:, :, None], x[at], 0).astype(np.float32), mask, at


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network | None:
    """A network trained on the pages' own marks; None if no page has blocks of both kinds."""
    parsed = [blocks(p) for p in pages]
    parsed = [p for p in parsed if p]
    marks = [[label(b) for b in p] for p in parsed]
    kinds = {m for p in marks for m in p}
    if not {0, 1} <= kinds:
        return None
    y = np.array([m or 0 for p in marks for m in p], np.float32)
    known = np.array([m is not None for p in marks for m in p])
    share = np.where(y == 1, 0.5 / max(1, (known & (y == 1)).sum()), 0.5 / max(1, (known & (y == 0)).sum())) * known
    share = (share * known.sum()).astype(np.float32)
    net = Network()
    r = np.random.RandomState(seed)
    weights = [*net.W, net.out]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        hide = r.rand(len(parsed)) < 0.5
        x, offsets = features(parsed, hide)
        order = r.permutation(len(parsed))
        for begin in range(0, len(order), 32):
            xs, mask, at = pad(x, offsets, order[begin : begin + 32])
            w = np.where(mask, share[at], 0)
            grads = net.gradients(xs, mask, y[at], (w / max(1.0, w.sum())).astype(np.float32))
            step += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                weights[k] -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(pages: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network of the pages that mark their content, up to the bound."""
    marked = pages.where(F.lower("html").rlike("<(article|main)[ >]"))
    rows = least_by_hash(marked, "page_id", sample, "html").select("html").collect()
    return train([r[0] for r in rows])


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every page. One narrow pass once the network is trained."""
    spark = ship(pages.sparkSession)
    shared = spark.sparkContext.broadcast(fit(pages, sample))  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sources = part.column(1).to_pylist()
                parsed = [blocks(s) if s else [] for s in sources]
                x, offsets = features(parsed)
                keep = (net.probabilities(x, offsets) >= 0.5) if net is not None else np.ones(len(x), bool)
                texts, kept = [], []
                for i, p in enumerate(parsed):
                    own = [b.text for b, k in zip(p, keep[offsets[i] : offsets[i + 1]].tolist()) if k]
                    texts.append(None if sources[i] is None else "\n\n".join(own))
                    kept.append(len(own))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(p) for p in parsed], pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "n_blocks", "n_content"])

    return pages.select(F.col("page_id").cast("long"), F.col("html")).mapInArrow(run, SCHEMA)
