"""Hashes of what a page draws, over a table of its objects. Pages of equal hashes need not be rendered; a page whose hash is null must be.

An object is a row (id, ord, kind, content, hashable): its page, place in drawing order, kind, and a digest of all that decides how it looks (geometry in hundredths of a point, style, pixels). An extractor makes them; what it cannot capture (a shading, optional content, a large image of an unknown colour space) it marks as not hashable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value
MAX_SEGMENTS = 200_000


def quantised(v: Column) -> Column:
    """A coordinate in hundredths of a point, halves away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) * 100 + 0.5)).cast("long")


def orientation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Quarter turns (0 to 3) of a text matrix, and 4 more if it mirrors."""
    turn = F.when(F.abs(a) >= F.abs(b), F.when(a >= 0, 0).otherwise(2)).otherwise(F.when(b >= 0, 1).otherwise(3))
    return turn + F.when(a * d - b * c < 0, 4).otherwise(0)


def geometry(rotation: Column, crop: Column, media: Column) -> Column:
    """The page's turn and visible box (crop within media; boxes are structs x0, y0, x1, y1) as one text."""
    side = lambda f, k: quantised(f(F.coalesce(crop[k], media[k]), media[k]))
    box = [side(F.greatest, "x0"), side(F.greatest, "y0"), side(F.least, "x1"), side(F.least, "y1")]
    return F.concat_ws(",", F.pmod(rotation, F.lit(4)), *box)


def content_hashes(objects: DataFrame, segments: str | None = None) -> DataFrame:
    """Per page: id, content. Null if any object is not hashable or the page has over MAX_SEGMENTS path segments (a column of objects). The order of objects counts; objects of one place, by kind and content."""
    each = F.array_sort(F.collect_list(F.struct("ord", "kind", F.coalesce("content", F.lit("")).alias("content"))))
    fine = F.bool_and(F.coalesce("hashable", F.lit(False)) & F.col("content").isNotNull())
    if segments:
        fine = fine & (F.sum(segments) <= MAX_SEGMENTS)
    told = objects.groupBy("id").agg(fine.alias("_fine"), F.sha2(F.array_join(F.transform(each, lambda x: F.concat_ws("\x1f", x["ord"], x["kind"], x["content"])), "\x1e"), 256).alias("_hash"))
    return told.select("id", F.when(F.col("_fine"), F.col("_hash")).alias("content"))


def single_object_hash(objects: DataFrame) -> DataFrame:
    """As content_hashes, for pages of one object each: its own digest, without a shuffle."""
    return objects.select("id", F.when(F.coalesce("hashable", F.lit(False)), F.col("content")).alias("content"))


def may_skip(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds `skips` to pairs (a, b) of pages (id, text_hash, objects, content): both have text, it hashes the same, as many objects, and equal content; null hashes never match."""
    side = lambda k, s: pages.select(F.col("id").alias(k), F.struct("text_hash", "objects", "content").alias(s))
    both = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b")
    equal = F.lit(True)
    for c in ("text_hash", "objects", "content"):
        equal = equal & F.coalesce(F.col(f"_x.{c}") == F.col(f"_y.{c}"), F.lit(False))
    return both.withColumn("skips", equal).drop("_x", "_y")
