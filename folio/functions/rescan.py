"""Tile differences of two scans of one paper, after undoing the shift, lean and exposure of the second.

All tiles are measured at once: a page becomes a table of summed areas, and a search over shifts is one lookup with an axis more for the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from folio.functions.image import tile_diff, tile_grey, tile_grid

# fixed values
MARGIN, SOFT_EDGE = 1, 2
SEARCH, REGION_SLACK, REFINE_SLACK, MATCH_SLACK = 2.0, 0.8, 0.3, 0.14
SHIFT_CAP, SETTLED = 30.0, 3.0
MAX_GAIN, MAX_BIAS = 1.25, 40.0
CLIP_LOW, CLIP_HIGH = 8, 245
SAMPLE, REGIONS, FIT_ROUNDS = 3, 3, 3


def _half_up(v: np.ndarray) -> np.ndarray:
    """Nearest whole number, halves away from zero."""
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


class Areas:
    """Sums of grey levels from the page's origin to every pixel corner, of the page blurred by a square of SOFT_EDGE pixels each way."""

    def __init__(self, img: np.ndarray) -> None:
        g = tile_grey(img).astype(float)
        self.h, self.w = g.shape
        n = 2 * SOFT_EDGE + 1
        for axis in (0, 1):
            wide = np.pad(g, [(SOFT_EDGE, SOFT_EDGE) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            g = sum(np.take(wide, range(k, k + g.shape[axis]), axis) for k in range(n))
        self.flat = np.pad((g / n**2).cumsum(0).cumsum(1), ((1, 0), (1, 0))).ravel()

    def _corner(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum up to (x, y), linear between pixel corners."""
        i, j = np.minimum(x.astype(np.int64), self.w - 1), np.minimum(y.astype(np.int64), self.h - 1)
        fx, fy = x - i, y - j
        s, wide, k = self.flat, self.w + 1, j * (self.w + 1) + i
        top, low = s.take(k), s.take(k + wide)
        top += fx * (s.take(k + 1) - top)
        low += fx * (s.take(k + wide + 1) - low)
        return top + fy * (low - top)

    def means(self, x: np.ndarray, y: np.ndarray, width: float, height: float) -> np.ndarray:
        """Means of rectangles of one size; NaN where one is not inside the page."""
        inside = (x >= 0) & (y >= 0) & (x + width <= self.w + 1e-9) & (y + height <= self.h + 1e-9)
        x, y = np.clip(x, 0, self.w), np.clip(y, 0, self.h)
        x2, y2 = np.minimum(x + width, self.w), np.minimum(y + height, self.h)
        total = self._corner(x2, y2) - self._corner(x, y2) - self._corner(x2, y) + self._corner(x, y)
        return np.where(inside, total / (width * height), np.nan)

    def whole_means(self, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        """Means of rectangles between whole pixels."""
        inside = (x >= 0) & (y >= 0) & (x2 <= self.w) & (y2 <= self.h)
        left, right = np.clip(x, 0, self.w), np.clip(x2, 0, self.w)
        top, low = np.clip(y, 0, self.h) * (self.w + 1), np.clip(y2, 0, self.h) * (self.w + 1)
        s = self.flat
        total = s.take(low + right) - s.take(low + left) - s.take(top + right) + s.take(top + left)
        return np.where(inside, total / ((x2 - x) * (y2 - y)), np.nan)


@dataclass(frozen=True)
class Field:
    """Shift of the second page at a point of the first, linear around the centre: dx grows with y and dy with x, as under a small turn."""

    dx: float = 0.0
    dx_by_y: float = 0.0
    dy: float = 0.0
    dy_by_x: float = 0.0
    cx: float = 0.0
    cy: float = 0.0

    def at(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.dx + self.dx_by_y * (y - self.cy), self.dy + self.dy_by_x * (x - self.cx)

    def back(self) -> Field:
        return Field(-self.dx, -self.dx_by_y, -self.dy, -self.dy_by_x, self.cx, self.cy)


@dataclass(frozen=True)
class Exposure:
    """Grey levels of the first page as the second shows them."""

    gain: float = 1.0
    bias: float = 0.0

    def shown(self, v: np.ndarray) -> np.ndarray:
        return np.clip(self.gain * v + self.bias, 0, 255)

    def difference(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """0 where both sides are clipped, near white or near black."""
        p = self.shown(first)
        clipped = ((p >= 250) & (second >= 245)) | ((p <= 5) & (second <= 10))
        return np.where(clipped, 0.0, np.abs(p - second))


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of least squares; slope 1 where x does not vary."""
    if not x.size:
        return 1.0, 0.0
    dx = x - x.mean()
    spread = float(dx @ dx)
    slope = float(dx @ (y - y.mean())) / spread if spread >= 1e-9 else 1.0
    return slope, float(y.mean() - slope * x.mean())


def exposure(x: np.ndarray, y: np.ndarray) -> Exposure:
    """Gain and bias between tile means of two pages, from the tiles that are not clipped and, in later rounds, follow the fit before."""
    open_ = (x >= CLIP_LOW) & (x <= CLIP_HIGH) & (y >= CLIP_LOW) & (y <= CLIP_HIGH)  # NaN is not
    x, y = x[open_], y[open_]
    keep = np.ones(x.size, bool)
    gain, bias = 1.0, 0.0
    for _ in range(FIT_ROUNDS):
        p, q = x[keep], y[keep]
        gain = float(np.clip(line(p, q)[0], 1 / MAX_GAIN, MAX_GAIN))
        bias = float(np.clip(q.mean() - gain * p.mean(), -MAX_BIAS, MAX_BIAS)) if p.size else 0.0
        rest = np.abs(y - gain * x - bias)
        keep = rest <= max(3.0, 2 * float(np.sqrt(np.mean(rest[keep] ** 2))) if keep.any() else 3.0)
    return Exposure(gain, bias)


class Tiles:
    """The tile grid of a page: inner tiles' places in pixels, and the sampled tiles of the search."""

    def __init__(self, w: int, h: int) -> None:
        self.w, self.h = w, h
        self.cols, self.rows = tile_grid(w, h)
        self.tw, self.th = w / self.cols, h / self.rows
        r, c = np.mgrid[MARGIN : self.rows - MARGIN, MARGIN : self.cols - MARGIN]
        self.index = (r * self.cols + c).ravel()
        self.x, self.y = c.ravel() * self.tw, r.ravel() * self.th
        r, c = (v.ravel() for v in np.mgrid[0 : self.rows : SAMPLE, 0 : self.cols : SAMPLE])
        self.left, self.top, self.right, self.bottom = c * self.tw, r * self.th, c * self.tw + self.tw, r * self.th + self.th

    def means(self, page: Areas, field: Field | None = None) -> np.ndarray:
        dx, dy = field.at(self.x, self.y) if field else (0.0, 0.0)
        return page.means(self.x + dx, self.y + dy, self.tw, self.th)

    def best_shift(self, a: Areas, b: Areas, e: Exposure, region: tuple, centre: tuple, reach: tuple, step: tuple) -> tuple[float, float]:
        """Of the shifts around the centre, in whole pixels, the first with the least variance of capped differences over the region's sampled tiles."""
        x0, y0, x1, y1 = region
        within = (self.left >= x0) & (self.top >= y0) & (self.right <= x1) & (self.bottom <= y1)
        x, y, x2, y2 = (_half_up(v[within]) for v in (self.left, self.top, self.right, self.bottom))
        nx, ny = int(reach[0] / step[0]), int(reach[1] / step[1])
        dx = np.tile(_half_up(centre[0] + np.arange(-nx, nx + 1) * step[0]), 2 * ny + 1)
        dy = np.repeat(_half_up(centre[1] + np.arange(-ny, ny + 1) * step[1]), 2 * nx + 1)
        dx_, dy_ = dx[:, None], dy[:, None]
        there = b.whole_means(x + dx_, y + dy_, x2 + dx_, y2 + dy_)
        d = np.clip(e.shown(a.whole_means(x, y, x2, y2)) - there, -SHIFT_CAP, SHIFT_CAP)
        seen = ~np.isnan(d)
        n = seen.sum(1)
        if not n.any():
            return 0.0, 0.0
        d = np.where(seen, d, 0.0)
        m = np.maximum(n, 1)
        cost = np.where(n > 0, (d**2).sum(1) / m - (d.sum(1) / m) ** 2, np.inf)
        i = int(cost.argmin())
        return float(dx[i]), float(dy[i])

    def field(self, a: Areas, b: Areas, e: Exposure, before: Field | None = None) -> Field:
        """Shifts of REGIONS x REGIONS regions, first coarse and then by pixels, and the lines through them. Without a field before, around the shift of the whole page."""
        tile = np.array([self.tw, self.th])
        start, slack = None, REFINE_SLACK
        if before is None:
            start, slack = self.best_shift(a, b, e, (0, 0, self.w, self.h), (0.0, 0.0), SEARCH * tile, tile / 2), REGION_SLACK
        found = []
        for j, i in np.ndindex(REGIONS, REGIONS):
            region = (self.w * i / REGIONS, self.h * j / REGIONS, self.w * (i + 1) / REGIONS, self.h * (j + 1) / REGIONS)
            x, y = (region[0] + region[2]) / 2, (region[1] + region[3]) / 2
            near = start if before is None else before.at(x, y)
            near = self.best_shift(a, b, e, region, near, slack * tile, tile / 4)
            found.append((x - self.w / 2, y - self.h / 2, *self.best_shift(a, b, e, region, near, tile / 4, (1, 1))))
        x, y, dx, dy = np.array(found).T
        by_y, at_x = line(y, dx)
        by_x, at_y = line(x, dy)
        return Field(at_x, by_y, at_y, by_x, self.w / 2, self.h / 2)

    def worst(self, own: Areas, other: Areas, e: Exposure, field: Field, own_is_second: bool) -> tuple[float, int]:
        """Largest difference between a tile of one page and its best match near its place on the other, and the tile's index.

        All tiles that do not match yet take a step to the best of their eight neighbours, at half the distance each round.
        """
        v = self.means(own)
        dx, dy = field.at(self.x, self.y)
        x, y = self.x + dx, self.y + dy

        def cost(at: slice | np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            u = other.means(x, y, self.tw, self.th)
            d = e.difference(u, v[at]) if own_is_second else e.difference(v[at], u)
            return np.where(np.isnan(u), np.inf, d)

        best = cost(slice(None), x, y)
        steps = np.array([(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j])
        step = MATCH_SLACK / 1.75
        while step >= MATCH_SLACK / 7 and (best > SETTLED).any():
            at = np.flatnonzero(best > SETTLED)
            px, py = x[at] + steps[:, :1] * step * self.tw, y[at] + steps[:, 1:] * step * self.th
            d = cost(at, px, py)
            k, j = d.argmin(0), np.arange(at.size)
            better = d[k, j] < best[at]
            x[at], y[at] = np.where(better, px[k, j], x[at]), np.where(better, py[k, j], y[at])
            best[at] = np.minimum(best[at], d[k, j])
            step /= 2
        best = np.where(np.isinf(best), 0.0, best)
        i = int(best.argmax())
        return float(best[i]), int(self.index[i]) if best[i] > 0 else 0


def aligned(a: Areas, b: Areas, tiles: Tiles) -> tuple[Exposure, Field]:
    """Exposure and shift in turns, as a shifted page fits poorly before: twice, and the exposure once more."""
    e, field = exposure(tiles.means(a), tiles.means(b)), None
    for _ in range(2):
        field = tiles.field(a, b, e, field)
        e = exposure(tiles.means(a), tiles.means(b, field))
    return e, field


def aligned_tile_diff(a: np.ndarray, b: np.ndarray) -> tuple[float, tuple[int, int, int, int] | None]:
    """Largest difference of tile means of two scans of one paper, marks on either page, and its tile (col, row, cols, rows). Pages of other sizes, and ones smaller than the grid, are compared as they are (tile_diff). Content that repeats evenly within the SEARCH tiles looked at can be matched one repeat off, and then differs."""
    h, w = a.shape[:2]
    tiles = Tiles(w, h)
    if a.shape[:2] != b.shape[:2] or w < tiles.cols or h < tiles.rows:
        return tile_diff(a, b)
    first, second = Areas(a), Areas(b)
    e, field = aligned(first, second, tiles)
    d, i = max(tiles.worst(first, second, e, field, False), tiles.worst(second, first, e, field.back(), True), key=lambda v: v[0])
    return d, (i % tiles.cols, i // tiles.cols, tiles.cols, tiles.rows)
