"""Pages compared by their rasters. A raster is a row (id, height, width, channels, pixels): 8 bits a sample, row by row.

Both rasters of a pair meet in one row, and Arrow batches bring a bounded number of them to a worker; decoding, hashing and comparing are NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import image as I
from folio.functions import rescan as A
from folio.operators import score as S
from folio.options import Options

_HASHES = "id long, dhash long, phash long, ahash long"
_COMPARED = "a long, b long, histogram double, dhash int, phash int, changed int, ink int, ink_tile array<int>, tile_diff double, tile array<int>, scan boolean"


def raster(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    p = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return p[:, :, 0] if channels == 1 else p


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def cell_rasters(cells: DataFrame, rows: int, cols: int, width: int, height: int) -> DataFrame:
    """Grey rasters of rows (id, cells): each of rows x cols values drawn as a block of width x height pixels."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pixels = [np.kron(np.asarray(c, np.uint8).reshape(rows, cols), np.ones((height, width), np.uint8)).tobytes() for c in pdf["cells"]]
            yield pd.DataFrame({"id": pdf["id"], "height": rows * height, "width": cols * width, "channels": 1, "pixels": pixels})

    return cells.mapInPandas(work, "id long, height int, width int, channels int, pixels binary")


def hashes(rasters: DataFrame) -> DataFrame:
    """id and the three perceptual hashes, as signed numbers."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [raster(*v) for v in zip(pdf["pixels"], pdf["height"], pdf["width"], pdf["channels"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"]} | {f.__name__: [_signed(f(i)) for i in images] for f in (I.dhash, I.phash, I.ahash)})

    return rasters.mapInPandas(work, _HASHES)


def compare_rasters(rasters: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): similarity of histograms, distances of hashes, changed pixels (null for other sizes), the most ink that appeared or went in a block of tiles and the largest difference of tile means, each with its place (null where the page is smaller than the grid).

    Pairs with `scan` true are two scans of one paper: their tiles are compared after undoing the shift, lean and exposure, and ink, which a moved page is full of, is null.
    """
    side = lambda k: F.struct("pixels", "height", "width", "channels").alias(k)
    scan = F.coalesce(F.col("scan"), F.lit(False)) if "scan" in pairs.columns else F.lit(False)
    both = pairs.select("a", "b", scan.alias("scan")).join(rasters.select(F.col("id").alias("a"), side("x")), "a").join(rasters.select(F.col("id").alias("b"), side("y")), "b")

    def one(x: dict, y: dict, scan: bool) -> tuple:
        p, q = (raster(v["pixels"], v["height"], v["width"], v["channels"]) for v in (x, y))
        ink, (diff, tile) = (None, A.aligned_tile_diff(p, q)) if scan else (I.ink_diff(p, q), I.tile_diff(p, q))
        distance = [(f(p) ^ f(q)).bit_count() for f in (I.dhash, I.phash)]
        return I.histogram_similarity(I.histogram(p), I.histogram(q)), *distance, I.changed_pixels(p, q), ink[0] if ink else None, list(ink[1]) if ink else None, diff if tile else None, list(tile) if tile else None, scan

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(*v) for v in zip(pdf["x"], pdf["y"], pdf["scan"], strict=True)]
            out = pd.DataFrame(rows, columns=["histogram", "dhash", "phash", "changed", "ink", "ink_tile", "tile_diff", "tile", "scan"]).astype({"changed": "Int32", "ink": "Int32"})
            out.insert(0, "b", pdf["b"].to_numpy())
            out.insert(0, "a", pdf["a"].to_numpy())
            yield out

    # comparing a pair takes far longer than moving it: dealt by pair, so that neither well compressed rasters nor a page of many pairs leave the work to a few tasks
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.select("a", "b", "x", "y", "scan").repartition(tasks, "a", "b").mapInPandas(work, _COMPARED)


def _hash_score(options: Options) -> Column:
    d, p = I.hash_similarity(F.col("dhash")), I.hash_similarity(F.col("phash"))
    one = {"dhash": d, "phash": p}.get(options.hash_type)
    return S.visual_score(F.col("histogram"), d, p) if one is None else F.when(F.col("histogram") < S.HISTOGRAM_REJECT, F.col("histogram") * 0.5).otherwise(one)


def score_pages(rasters: DataFrame, pairs: DataFrame, texts: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Per pair (a, b): similarity, text_changed, tile_similarity, tile_changed, is_different.

    The histogram rejects, hashes score, text adjusts (texts: a, b, both_have_text, same, text_similarity), and tiles decide where the text did not change: ink that appeared or went, or a tile whose mean moved as by an edit in a photo. Text that differs where no pixel does was not seen and counts as the same. A score down to SCAN_FLOOR whose tiles did not change is noise of drawing, and is lifted. Pairs with `scan` true (pages that are images without text) are judged by their aligned tiles alone, with the same lift.
    """
    v = compare_rasters(rasters, pairs)
    if texts is None:
        v = v.withColumns({"both_have_text": F.lit(False), "same": F.lit(True), "text_similarity": F.lit(None).cast("double")})
    else:
        v = v.join(texts, ["a", "b"], "left")
    unseen = F.coalesce(F.col("changed") == 0, F.lit(False))
    have, same = F.coalesce("both_have_text", F.lit(False)), F.coalesce("same", F.lit(True)) | unseen
    changed = have & ~same
    base = S.text_adjust(_hash_score(options), have, same, F.when(~unseen, F.col("text_similarity")))
    photo = F.coalesce(F.col("tile_diff") > I.PHOTO_TOLERANCE, F.lit(False))
    ink = F.col("ink").isNotNull()
    tiles = F.lit(options.tiles) & ~changed & (ink | F.col("tile_diff").isNotNull())
    ink_like = F.when(photo, F.least(I.ink_score(F.col("ink")), I.tile_score(F.col("tile_diff")))).otherwise(I.ink_score(F.col("ink")))
    tile_like = F.when(ink, ink_like).otherwise(I.tile_score(F.col("tile_diff")))
    moved = F.when(ink, (F.col("ink") > I.INK_TOLERANCE) | photo).otherwise(F.col("tile_diff") > I.TILE_TOLERANCE)
    rows = v.select("a", "b", base.alias("base"), changed.alias("text_changed"), F.when(tiles, tile_like).alias("tile_similarity"), (tiles & F.coalesce(moved, F.lit(False))).alias("tile_changed"), (ink | F.col("scan")).alias("lifts"))
    lifted = F.col("lifts") & F.col("tile_similarity").isNotNull() & ~F.col("tile_changed") & (F.col("base") >= S.SCAN_FLOOR)
    similarity = F.when(lifted, F.greatest("base", "tile_similarity")).otherwise(F.col("base"))
    rows = rows.select("a", "b", similarity.alias("similarity"), "text_changed", "tile_similarity", "tile_changed")
    return rows.withColumn("is_different", S.page_different(F.col("similarity"), F.col("text_changed"), F.col("tile_changed"), options.threshold, options.text_change == "fails"))
