"""Image functions over arrays of pixels (height, width[, channels]), 8 bits each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
TILE_COLS, TILE_ROWS = 64, 90
TILE_TOLERANCE, TILE_SCALE = 6.0, 120.0
INK_CONTRAST, INK_FLAT, INK_TOLERANCE, INK_SCALE = 64, 24, 15, 300.0
PHOTO_TOLERANCE, SIZE_SLACK = 30.0, 2
HISTOGRAM_STEP, HISTOGRAM_RANGE = 4, 441.67


def planes(img: np.ndarray) -> np.ndarray:
    return img[:, :, None] if img.ndim == 2 else img[:, :, :3]


def grey(img: np.ndarray, weights: tuple[int, int, int], shift: int | None = None, scale: int = 1) -> np.ndarray:
    if img.ndim == 2:
        return img.astype(np.int64)
    total = (img[:, :, :3].astype(np.int64) * weights).sum(2)
    return total >> shift if shift else total // scale


def hash_grey(img: np.ndarray) -> np.ndarray:
    """299, 587, 114 thousandths on 16-bit channels, high byte."""
    if img.ndim == 2:
        return img.astype(np.int64)
    return ((img[:, :, :3].astype(np.int64) * 257 * (299, 587, 114)).sum(2) // 1000) >> 8


def tile_grey(img: np.ndarray) -> np.ndarray:
    return grey(img, (77, 150, 29), 8)


def resized(g: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area average; each output pixel is the mean of the source cells it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * m / n

    return weights(g.shape[0], rows) @ g.astype(float) @ weights(g.shape[1], cols).T


def _packed(bits: np.ndarray) -> int:
    return sum(1 << int(i) for i in np.flatnonzero(bits))


def dhash(img: np.ndarray) -> int:
    """Bit y * 8 + x: a pixel is darker than the one to its right."""
    g = np.round(resized(hash_grey(img), 8, 9))
    return _packed((g[:, :-1] < g[:, 1:]).ravel())


def phash(img: np.ndarray) -> int:
    """Which of 64 low frequencies besides the constant lie above their mean: the 8 x 8 block's other 63 and the next of the first row."""
    g = np.round(resized(hash_grey(img), 32, 32))
    k = np.arange(32)
    c = np.sqrt(2 / 32) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    c[0] = np.sqrt(1 / 32)
    d = c @ g @ c.T
    terms = np.append(d[:8, :8].ravel()[1:], d[0, 8])
    terms[np.abs(terms) < 1e-9] = 0
    return _packed(terms > terms.mean())


def ahash(img: np.ndarray) -> int:
    g = np.floor(resized(hash_grey(img), 8, 8))
    return _packed((g > np.floor(g.mean())).ravel())


def histogram(img: np.ndarray) -> tuple[float, float, float, float]:
    p = planes(img)
    if not p.size:
        return 0.0, 0.0, 0.0, 0.0
    m = p[::HISTOGRAM_STEP, ::HISTOGRAM_STEP].reshape(-1, p.shape[2]).mean(0)
    r, g, b = m if len(m) == 3 else (m[0],) * 3
    return float(r), float(g), float(b), float(0.299 * r + 0.587 * g + 0.114 * b)


def histogram_similarity(a: tuple, b: tuple) -> float:
    return max(0.0, 1 - float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a[:3], b[:3], strict=True)))) / HISTOGRAM_RANGE)


def tile_grid(w: int, h: int) -> tuple[int, int]:
    return (TILE_ROWS, TILE_COLS) if w > h else (TILE_COLS, TILE_ROWS)


def tile_means(img: np.ndarray, cols: int, rows: int) -> np.ndarray | None:
    h, w = img.shape[:2]
    if w < cols or h < rows:
        return None
    x, y = np.arange(cols) * w // cols, np.arange(rows) * h // rows
    sums = np.add.reduceat(np.add.reduceat(tile_grey(img), y, 0), x, 1)
    return sums / (np.diff(np.append(y, h))[:, None] * np.diff(np.append(x, w))[None, :])


def tile_diff(a: np.ndarray, b: np.ndarray) -> tuple[float, tuple[int, int, int, int] | None]:
    """Largest difference of tile means, and its first tile (col, row, cols, rows)."""
    cols, rows = tile_grid(a.shape[1], a.shape[0])
    ma, mb = tile_means(a, cols, rows), tile_means(b, cols, rows)
    if ma is None or mb is None:
        return 0.0, None
    d = np.abs(ma - mb)
    i = int(d.argmax())
    return float(d.flat[i]), (i % cols, i // cols, cols, rows)


def _neighbours(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of each pixel's 3 x 3 neighbourhood."""
    wide = np.pad(p, 1, mode="edge")
    h, w = p.shape
    lo = hi = p
    for y in range(3):
        for x in range(3):
            part = wide[y : y + h, x : x + w]
            lo, hi = np.minimum(lo, part), np.maximum(hi, part)
    return lo, hi


def ink_diff(a: np.ndarray, b: np.ndarray) -> tuple[int, tuple[int, int, int, int]] | None:
    """Most pixels of a 2 x 2 block of tiles where ink stands out from flat paper of the other page. None where sizes differ by over SIZE_SLACK or the page is smaller than the grid."""
    (h1, w1), (h2, w2) = a.shape[:2], b.shape[:2]
    if abs(h1 - h2) > SIZE_SLACK or abs(w1 - w2) > SIZE_SLACK:
        return None
    h, w = min(h1, h2), min(w1, w2)
    cols, rows = tile_grid(w, h)
    if w < cols or h < rows:
        return None
    pa, pb = planes(a)[:h, :w].astype(np.int16), planes(b)[:h, :w].astype(np.int16)
    n = max(pa.shape[2], pb.shape[2])
    changed = np.zeros((h, w), bool)
    for k in range(n):
        x, y = pa[:, :, min(k, pa.shape[2] - 1)], pb[:, :, min(k, pb.shape[2] - 1)]
        for v, p in ((x, y), (y, x)):
            lo, hi = _neighbours(p)
            changed |= (hi - lo <= INK_FLAT) & ((v + INK_CONTRAST <= lo) | (v >= hi + INK_CONTRAST))
    at = (np.arange(h) * rows // h)[:, None] * cols + (np.arange(w) * cols // w)[None, :]
    counts = np.bincount(at[changed], minlength=cols * rows).reshape(rows, cols)
    wide = np.pad(counts, ((0, 1), (0, 1)))
    blocks = wide[:-1, :-1] + wide[:-1, 1:] + wide[1:, :-1] + wide[1:, 1:]
    i = int(blocks.argmax())
    return int(blocks.flat[i]), (i % cols, i // cols, cols, rows)


def changed_pixels(a: np.ndarray, b: np.ndarray) -> int | None:
    """Pixels that differ by INK_CONTRAST on any channel; None for different sizes."""
    if a.shape[:2] != b.shape[:2]:
        return None
    return int((np.abs(planes(a).astype(np.int16) - planes(b)) >= INK_CONTRAST).any(2).sum())


# -- columns --


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(distance: Column) -> Column:
    return 1 - distance / F.lit(64.0)


def histogram_similarity_column(a: list[Column], b: list[Column]) -> Column:
    total = sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - F.sqrt(total) / HISTOGRAM_RANGE)


def ink_score(n: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - n / F.lit(INK_SCALE))


def tile_score(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / F.lit(TILE_SCALE))


def combined_distance(d: Column, p: Column) -> Column:
    """Of two hashes' distances, the mean as a whole number."""
    return F.floor((d + p) / 2).cast("long")


def combined_similarity(d: Column, p: Column) -> Column:
    return (hash_similarity(d) + hash_similarity(p)) / 2
