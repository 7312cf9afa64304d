"""The instruction interpreter: arithmetic, control flow, moves and what they leave when a program is at fault."""

from pathlib import Path

import numpy as np
import pytest

from tests.test_fonts import truetype
from vellum.kernel import hinting, outlines, raster
from vellum.kernel.hinting import Fault, Machine

SQUARE = [(105, 0), (505, 0), (505, 403), (105, 403)]


def machine(**kw):
    return Machine(1000, 10, **({"twilight": 4, "storage": 8} | kw))


def stack(*code, **kw):
    m = machine(**kw)
    m.run(bytes(code))
    return m.stack


def fitted(*code, points=SQUARE, m=None, on=None):
    m = m or machine()
    return m.fit(points, on or [True] * len(points), [len(points) - 1], points[0][0], 600, bytes(code))[0]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ((0xB2, 5, 7, 2, 0x61), [5, 5]), ((0xB8, 0xFF, 0x9C, 0x64), [100]), ((0xB1, 64, 32, 0x63), [32]), ((0xB1, 10, 64, 0x62), [10]), ((0xB0, 65, 0x66), [64]), ((0xB0, 65, 0x67), [128]),
        ((0xB0, 31, 0x68), [0]), ((0xB0, 32, 0x68), [64]), ((0xB8, 0xFF, 0xE0, 0x68), [-64]), ((0x19, 0xB0, 70, 0x68), [96]), ((0x3D, 0xB0, 50, 0x68), [64]), ((0x7D, 0xB0, 127, 0x68), [64]), ((0x7C, 0xB0, 65, 0x68), [128]),
        ((0x7A, 0xB0, 65, 0x68), [65]), ((0xB0, 0x48, 0x76, 0xB0, 33, 0x68), [64]), ((0xB2, 1, 2, 3, 0x8A), [2, 3, 1]), ((0xB3, 9, 8, 7, 2, 0x25), [9, 8, 7, 8]), ((0xB3, 9, 8, 7, 3, 0x26), [8, 7, 9]), ((0xB1, 4, 3, 0x23), [3, 4]),
        ((0xB0, 1, 0x58, 0xB0, 2, 0x1B, 0xB0, 3, 0x59), [2]), ((0xB0, 0, 0x58, 0xB0, 2, 0x58, 0x1B, 0x59, 0x1B, 0xB0, 3, 0x59), [3]), ((0xB0, 2, 0x1C, 0x4B, 0x24), [0]), ((0xB1, 3, 0, 0x78, 0x4B), [10]), ((0xB0, 64, 0x56), [1]),
        ((0xB1, 3, 77, 0x42, 0xB0, 3, 0x43), [77]), ((0xB0, 0x21, 0x88), [0x1028]), ((0x01, 0x0C), [0x4000, 0]), ((0xB1, 3, 4, 0x8B, 0xB0, 9, 0x8C), [4]),
    ],
)
def test_values_and_control(code, want):
    assert stack(*code) == want


def test_functions():
    font = bytes([0xB0, 5, 0x2C, 0xB0, 1, 0x60, 0x2D])
    assert stack(0xB2, 10, 3, 5, 0x2A, font=font) == [13] and stack(0xB1, 10, 5, 0x2B, font=font) == [11]
    assert stack(0xB0, 0x91, 0x89, 0xB0, 6, 0x2D, 0x91) == [6]


def test_control_values():
    m = machine(cvt=[100, -50], size=bytes([0xB1, 1, 70, 0x44]))
    assert m.cvt == [64, 70]
    # Point 2 stands in reach of the value and takes it; beyond the cut-in it stays.
    assert [p[1] for p in fitted(0x00, 0xB1, 2, 0, 0x3F, m=machine(cvt=[480]))] == [0, 0, 320, 258]
    assert [p[1] for p in fitted(0x00, 0xB1, 2, 0, 0x3F, m=machine(cvt=[900]))] == [0, 0, 256, 258]
    assert fitted(0x00, 0xB1, 0, 0, 0x44, m=(m := machine(cvt=[480]))) and m.cvt == [0] and fitted(m=m) and m.cvt == [307]


def test_edges_go_to_the_grid_and_the_rest_follows():
    # The left edge is rounded, the right one at a rounded distance, then the other points follow.
    got = fitted(0x01, 0xB0, 0, 0x2F, 0xB0, 1, 0xC4, 0x31)
    assert got == [[64, 0], [320, 0], [320, 258], [64, 258]]
    # A point between two touched ones keeps its share of the way.
    got = fitted(0x01, 0xB0, 0, 0x2F, 0xB0, 2, 0x2F, 0x31, points=[(105, 0), (305, 0), (505, 0)])
    assert [p[0] for p in got] == [64, 192, 320]
    # IP between reference points; SHPIX; ALIGNRP; MSIRP.
    assert [p[0] for p in fitted(0x01, 0xB0, 0, 0x2F, 0xB0, 1, 0xD4, 0xB0, 0, 0x11, 0xB0, 1, 0x12, 0xB0, 2, 0x39)][:3] == [64, 320, 320]
    assert [p[0] for p in fitted(0x01, 0xB1, 1, 32, 0x38)] == [67, 355, 323, 67]
    assert [p[0] for p in fitted(0x01, 0xB0, 0, 0x10, 0xB0, 3, 0x3C, 0xB1, 1, 128, 0x3A)] == [67, 195, 323, 67]
    # Deltas: at 10 pixels (9 + 1) the third point goes up by a pixel's eighth.
    assert [p[1] for p in fitted(0x00, 0xB2, 0x18, 2, 1, 0x5D)] == [0, 0, 266, 258]
    # The lines through two pairs of points meet at a point.
    assert fitted(0xB4, 4, 0, 2, 1, 3, 0x0F, points=[(0, 0), (400, 0), (400, 400), (0, 400), (9, 9)])[4] == [128, 128]


@pytest.mark.parametrize("code", [(0x21,), (0xB0, 0, 0x45), (0xB0, 9, 0x2B), (0x91,), (0xB0, 99, 0x2F), (0xB8, 0), (0xB0, 0, 0x58), (0xB1, 1, 0, 0x62), (0xB0, 0, 0x1C), (0xB8, 0xFF, 0xFD, 0x1C), (0xB0, 7, 0x2C, 0xB0, 7, 0x2B, 0x2D, 0xB0, 7, 0x2B), (0xB0, 5, 0x13)])
def test_faults(code, monkeypatch):
    monkeypatch.setattr(hinting, "BUDGET", 20_000)
    with pytest.raises(Fault):
        fitted(*code)


def test_programs_of_noise(monkeypatch):
    monkeypatch.setattr(hinting, "BUDGET", 2_000)
    r = np.random.RandomState(3)
    for _ in range(2_000):
        try:
            fitted(*r.randint(0, 256, r.randint(1, 60)).tolist(), m=machine(cvt=[1, 2, 300]))
        except Fault:
            pass


def test_scaled_where_there_is_no_program():
    p = outlines.Program(truetype())
    assert p.hinted(1, 10).contours == [[tuple((x * 0.64, y * 0.64) for x, y in s) for s in c] for c in p.glyph(1).contours]
    assert raster.render(p, 1, 100, hinted=True).coverage == raster.render(p, 1, 100).coverage and p.hinted(1, 0).contours == [] and p.hinted(10**6, 9).contours == []


FONT = Path("/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf")


@pytest.mark.skipif(not FONT.exists(), reason="no font of the system's")
def test_stems_of_a_real_font():
    p = outlines.Program(FONT.read_bytes())
    for size in (11, 17, 24):
        h = raster.render(p, p.font.codes[ord("H")], size, hinted=True)
        assert set(h.coverage) == {0, 255}  # all edges lie between pixels
        near = [abs(a - b * size * 64 / p.units) for c in "abcdeghnopqrst" for g in [p.font.codes[ord(c)]] for s, t in zip(p.hinted(g, size).contours, p.glyph(g).contours) for u, v in zip(s, t) for m, n in zip(u, v) for a, b in zip(m, n)]
        assert max(near) < 128 and sum(near) / len(near) < 48
