"""Scores, decisions and verdicts as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
HISTOGRAM_REJECT, PHASH_SKIP, SCAN_FLOOR, THUMBNAIL_EXIT = 0.8, 0.4, 0.85, 0.5


def cascade(d_similarity: Column, p_similarity: Column) -> Column:
    return F.when(d_similarity < PHASH_SKIP, d_similarity).otherwise((d_similarity + p_similarity) / 2)


def visual_score(histogram: Column, d_similarity: Column, p_similarity: Column) -> Column:
    return F.when(histogram < HISTOGRAM_REJECT, histogram * 0.5).otherwise(cascade(d_similarity, p_similarity))


def text_adjust(similarity: Column, both_have_text: Column, same: Column, text_similarity: Column) -> Column:
    """Same text lifts a close score to 0.99; other text costs 5% and caps the score by its own similarity."""
    lifted = F.when(similarity > 0.9, F.greatest(similarity, F.lit(0.99))).otherwise(similarity)
    lowered = F.least(similarity * 0.95, F.coalesce(text_similarity, F.lit(2.0)))
    return F.when(~both_have_text, similarity).when(same, lifted).otherwise(lowered)


def page_different(similarity: Column, text_changed: Column, tile_changed: Column, threshold: float, text_fails: bool = True) -> Column:
    return (similarity < threshold) | (text_changed & F.lit(text_fails)) | tile_changed


def summary(pages: DataFrame, *keys: str, more: Sequence[Column] = ()) -> DataFrame:
    """Per pair, from page rows (similarity, text_changed, tile_changed, is_different, page_no): worst (1 for none), mean (0 for none), any change, changed pages; and further aggregates."""
    return pages.groupBy(*keys).agg(
        F.coalesce(F.min("similarity"), F.lit(1.0)).alias("worst"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean"), F.coalesce(F.bool_or("text_changed"), F.lit(False)).alias("text_changed"),
        F.coalesce(F.bool_or("tile_changed"), F.lit(False)).alias("tile_changed"), F.array_sort(F.collect_list(F.when(F.col("is_different"), F.col("page_no")))).alias("different_pages"), F.count("similarity").alias("pages_compared"), *more,
    )


def needs_full_scan(auto: Column, sampled: Column, n: Column, worst: Column, text_changed: Column, tile_changed: Column, threshold: float = 0.95, text_fails: bool = True, tiles: bool = True) -> Column:
    return auto & (sampled < n) & (worst >= threshold) & (~text_changed | F.lit(not text_fails)) & (~tile_changed | F.lit(not tiles))


def similar(score: Column, byte_only: Column, pages_added: Column, text_changed: Column, tile_changed: Column, threshold: float = 0.95, text_fails: bool = True, tiles: bool = True) -> Column:
    return ~byte_only & ~pages_added & ~(text_changed & F.lit(text_fails)) & ~(tile_changed & F.lit(tiles)) & (score >= threshold)


def status(identical: Column, is_similar: Column) -> Column:
    return F.when(identical, "IDENTICAL").when(is_similar, "SIMILAR").otherwise("DIFFERENT")
