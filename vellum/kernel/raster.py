"""Outlines to coverage: curves are flattened, edges swept over eight sub-scanlines with exact horizontal
coverage, filled by the non-zero winding rule."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from vellum.kernel.outlines import Contours, Program

TOLERANCE, DEPTH, SUB = 0.2, 18, 8


@dataclass
class Bitmap:
    """8-bit coverage; ``left`` and ``top`` place its upper left corner against the glyph's origin."""

    width: int
    height: int
    left: int
    top: int
    coverage: bytes


def flatten(contours: Contours, scale: float) -> list[list[tuple[float, float]]]:
    """Closed polygons in pixels, y up."""
    out = []
    for contour in contours:
        points: list[tuple[float, float]] = []
        for segment in contour:
            s = [(x * scale, y * scale) for x, y in segment]
            if not points:
                points.append(s[0])
            _curve(s, points, 0)
        if len(points) > 2:
            out.append(points)
    return out


def _curve(s: list[tuple[float, float]], out: list[tuple[float, float]], depth: int) -> None:
    if len(s) == 2 or depth >= DEPTH or _flat(s):
        out.append(s[-1])
        return
    left, right, row = [s[0]], [s[-1]], s
    while len(row) > 1:
        row = [((a + c) / 2, (b + d) / 2) for (a, b), (c, d) in zip(row, row[1:])]
        left.append(row[0])
        right.append(row[-1])
    _curve(left, out, depth + 1)
    _curve(right[::-1], out, depth + 1)


def _flat(s: list[tuple[float, float]]) -> bool:
    (x0, y0), (x1, y1) = s[0], s[-1]
    dx, dy = x1 - x0, y1 - y0
    n = math.hypot(dx, dy)
    away = lambda x, y: abs((x - x0) * dy - (y - y0) * dx) / n if n else math.hypot(x - x0, y - y0)
    return all(away(x, y) <= TOLERANCE for x, y in s[1:-1])


def fill(polygons: list[list[tuple[float, float]]]) -> Bitmap:
    points = [p for poly in polygons for p in poly]
    if not points:
        return Bitmap(0, 0, 0, 0, b"")
    left, right = math.floor(min(x for x, _ in points)), math.ceil(max(x for x, _ in points))
    low, high = math.floor(min(y for _, y in points)), math.ceil(max(y for _, y in points))
    w, h = max(1, right - left), max(1, high - low)
    edges = []
    for poly in polygons:
        for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1]):
            if y0 != y1:
                edges.append((y0, y1, x0, (x1 - x0) / (y1 - y0)) if y0 < y1 else (y1, y0, x1, (x1 - x0) / (y1 - y0)))
    up = [1 if y0 < y1 else -1 for poly in polygons for (_, y0), (_, y1) in zip(poly, poly[1:] + poly[:1]) if y0 != y1]
    e = np.array(edges).reshape(-1, 4)
    sign = np.array(up, int)
    acc = np.zeros((h, w + 2))
    for k in range(h * SUB):
        y = high - (k + 0.5) / SUB
        on = np.flatnonzero((e[:, 0] <= y) & (y < e[:, 1]))
        if not len(on):
            continue
        x = e[on, 2] + (y - e[on, 0]) * e[on, 3] - left
        order = np.argsort(x, kind="stable")
        x, winding = x[order], np.cumsum(sign[on][order])
        before = np.concatenate([[0], winding[:-1]])
        begins, ends = x[(before == 0) & (winding != 0)], x[(before != 0) & (winding == 0)]
        row = acc[k // SUB]
        for a, b in zip(np.clip(begins, 0, w).tolist(), np.clip(ends, 0, w).tolist()):
            i, j = int(a), int(b)
            if i == j:
                row[i] += b - a
            else:
                row[i] += i + 1 - a
                row[i + 1 : j] += 1
                row[j] += b - j
    return Bitmap(w, h, left, high, np.floor(np.clip(acc[:, :w] / SUB, 0, 1) * 255 + 0.5).astype(np.uint8).tobytes())


def render(program: Program, glyph, size: float, hinted: bool = False) -> Bitmap:
    """A glyph at ``size`` pixels to the em; ``hinted`` fits it to the grid of the nearest whole size."""
    if hinted and size > 0:
        return fill(flatten(program.hinted(glyph, max(1, round(size))).contours, 1 / 64))
    return fill(flatten(program.glyph(glyph).contours, size / program.units))
