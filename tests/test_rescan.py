"""Scans of one paper: shifted, exposed otherwise and turned pages match, marks do not."""

import numpy as np
import pytest

from folio.functions import image as I
from folio.functions import rescan as A
from folio.operators import visual

H, W = 594, 420
LIMIT = 0.6 * I.TILE_TOLERANCE


def smooth():
    y, x = np.mgrid[:H, :W]
    return (150 + 50 * np.sin(x / 45) + 40 * np.cos(y / 65 + x / 100)).astype(np.uint8)


def printed():
    """Lines further apart than the search reaches: evenly repeated lines within its reach can be matched one off."""
    rng = np.random.default_rng(1)
    p = np.full((H, W), 235, np.uint8)
    for y in range(40, 550, 31):
        x = 30
        while x < 380:
            n = int(rng.integers(10, 40))
            p[y : y + 8, x : x + n] = np.where(np.arange(min(n, W - x)) % 3 < 2, 60, 235)
            x += n + 7
    return p


def moved(p, dx, dy):
    out = np.zeros_like(p)
    out[max(dy, 0) : H + min(dy, 0), max(dx, 0) : W + min(dx, 0)] = p[max(-dy, 0) : H - max(dy, 0), max(-dx, 0) : W - max(dx, 0)]
    return out


def exposed(p, gain, bias):
    return np.clip(gain * p.astype(float) + bias, 0, 255).astype(np.uint8)


def stamped(p):
    p = p.copy()
    p[450:480, 300:360] = 30
    return p


@pytest.mark.parametrize("page", [smooth, printed])
def test_the_same_paper(page):
    p = page()
    assert A.aligned_tile_diff(p, p)[0] == 0
    for shift in ((1, 0), (0, -2), (3, 2), (-4, 5)):
        assert A.aligned_tile_diff(p, moved(p, *shift))[0] <= LIMIT
    assert I.tile_diff(p, moved(p, 3, 2))[0] > I.TILE_TOLERANCE
    for gain, bias in ((1, 15), (1, -15), (1.08, 0), (0.92, 10)):
        assert A.aligned_tile_diff(p, exposed(p, gain, bias))[0] <= LIMIT
    assert A.aligned_tile_diff(p, exposed(p, 0.5, 0))[0] > I.TILE_TOLERANCE


@pytest.mark.parametrize("page", [smooth, printed])
def test_marks_on_either_page(page):
    p = page()
    marked = stamped(moved(p, 2, -3))
    for a, b in ((p, marked), (marked, p), (p, np.zeros_like(p))):
        d, tile = A.aligned_tile_diff(a, b)
        assert d > I.TILE_TOLERANCE and tile[2:] == (64, 90)
    col, row = A.aligned_tile_diff(p, marked)[1][:2]
    assert 295 <= col * W / 64 + 3 <= 365 and 440 <= row * H / 90 + 3 <= 485


def test_other_sizes_are_compared_as_they_are():
    flat = lambda h, w, v: np.full((h, w), v, np.uint8)
    assert A.aligned_tile_diff(flat(900, 640, 180), flat(450, 320, 20)) == I.tile_diff(flat(900, 640, 180), flat(450, 320, 20))
    assert A.aligned_tile_diff(flat(10, 10, 0), flat(10, 10, 255)) == (0.0, None)
    a, b = flat(640, 900, 180), flat(640, 900, 180)
    b[300:340, 300:360] = 20
    assert A.aligned_tile_diff(a, b)[0] > I.TILE_TOLERANCE and A.aligned_tile_diff(a, b)[1][2:] == (90, 64)
    colour = np.stack([smooth()] * 3, 2)
    assert A.aligned_tile_diff(smooth(), colour)[0] <= LIMIT


def test_areas_hold_the_blurred_means():
    p = np.random.default_rng(2).integers(0, 256, (12, 9), dtype=np.uint8)
    wide = np.pad(p.astype(float), A.SOFT_EDGE, mode="edge")
    soft = np.array([[wide[y : y + 5, x : x + 5].mean() for x in range(9)] for y in range(12)])
    areas = A.Areas(p)
    one = lambda x, y, w, h: float(areas.means(np.array(float(x)), np.array(float(y)), w, h))
    assert one(2, 3, 4, 5) == pytest.approx(soft[3:8, 2:6].mean())
    assert float(areas.whole_means(*np.array([2, 3, 6, 8]))) == pytest.approx(soft[3:8, 2:6].mean())
    assert one(8, 11, 1, 1) == pytest.approx(soft[11, 8])
    assert one(2.5, 3, 1, 1) == pytest.approx((soft[3, 2] + soft[3, 3]) / 2)
    assert np.isnan(one(-1, 0, 3, 3)) and np.isnan(one(7, 0, 3, 3)) and np.isnan(one(0, 10, 3, 3))


def test_exposure_leaves_marked_tiles_out():
    x = 100 + np.arange(400) % 120.0
    y = 1.05 * x + 8
    y[:8] = 20
    e = A.exposure(x, y)
    assert e.gain == pytest.approx(1.05, abs=0.01) and e.bias == pytest.approx(8, abs=1)
    assert A.exposure(np.array([]), np.array([])) == A.Exposure()
    assert A.exposure(x, x / 2).gain == 0.8 and A.exposure(x, 3 * x) == A.Exposure()  # all of it clipped
    e = A.Exposure(1.1, 0)
    assert e.difference(np.array([250.0, 2.0, 100.0]), np.array([246.0, 9.0, 100.0])) == pytest.approx([0, 0, 10])


def turned(p, degrees):
    """Turned around the centre, linear between pixels; the edge goes on outside."""
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:H, :W] - np.array([H / 2, W / 2])[:, None, None]
    u, v = np.clip(x * np.cos(t) + y * np.sin(t) + W / 2, 0, W - 1.001), np.clip(-x * np.sin(t) + y * np.cos(t) + H / 2, 0, H - 1.001)
    i, j = u.astype(int), v.astype(int)
    f, g = u - i, v - j
    q = p.astype(float)
    return ((q[j, i] * (1 - f) + q[j, i + 1] * f) * (1 - g) + (q[j + 1, i] * (1 - f) + q[j + 1, i + 1] * f) * g).round().astype(np.uint8)


@pytest.mark.parametrize("page", [smooth, printed])
def test_a_small_turn(page):
    p = page()
    q = turned(p, 0.4)
    assert A.aligned_tile_diff(p, q)[0] <= I.TILE_TOLERANCE
    assert A.aligned_tile_diff(p, stamped(q))[0] > I.TILE_TOLERANCE


def test_a_turn_is_a_field():
    f = A.Field(2, 0.01, -3, -0.01, 100, 200)
    assert f.at(np.array(110.0), np.array(220.0)) == (pytest.approx(2.2), pytest.approx(-3.1))
    assert f.back().at(np.array(110.0), np.array(220.0)) == (pytest.approx(-2.2), pytest.approx(3.1))


def test_scan_pairs(spark):
    again = np.pad(smooth(), ((2, 0), (3, 0)), mode="edge")[:H, :W]
    images = {1: smooth(), 2: again, 3: stamped(again), 4: moved(smooth(), 3, 2)}
    rasters = spark.createDataFrame([(i, *p.shape, 1, bytearray(p.tobytes())) for i, p in images.items()], "id long, height int, width int, channels int, pixels binary")
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 3, False), (1, 4, True), (4, 1, None)], "a long, b long, scan boolean")
    got = {(r.a, r.b): r for r in visual.score_pages(rasters, pairs).collect()}
    assert not got[1, 2].tile_changed and got[1, 2].similarity >= 0.95 and not got[1, 2].is_different
    assert got[1, 3].tile_changed and got[1, 3].is_different and got[2, 3].tile_changed
    assert not got[1, 4].tile_changed and got[4, 1].tile_changed  # the same pages, not said to be scans
