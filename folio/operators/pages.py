"""Pages of documents, page selection, and pairs of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The pages of a text: its lines that are not blank."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")


def paginate(docs: DataFrame) -> DataFrame:
    """doc_id, page_no (from 1), text: a page for each line that is not blank. Numbers are given inside each row, so no shuffle is needed."""
    return docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def page_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(lines(F.coalesce("text", F.lit("")))).cast("long").alias("n_pages"))


def all_pages(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def thumbnail_pages(n: Column) -> Column:
    return F.when(n > 0, F.array_distinct(F.array(F.lit(0), (n - 1).cast("int")))).otherwise(F.array().cast("array<int>"))


def strategic_pages(n: Column) -> Column:
    """First, middle and last page and about the root of n more, evenly spread; all of up to five."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("int")
    more = F.transform(F.sequence(F.lit(1), F.greatest(root - 1, F.lit(1))), lambda i: F.floor((n - 1).cast("double") / root * i).cast("int"))
    some = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.floor(n / 2).cast("int"), (n - 1).cast("int")), more)))
    return F.when(n <= 5, all_pages(n)).otherwise(some)


#: Ids of a range whose documents are put in order by one task.
RANGE = 1 << 16


def consecutive_pairs(docs: DataFrame, by: str = "source", ident: str = "doc_id") -> DataFrame:
    """a, b: each document and the next of its source.

    Ids are dealt into ranges of RANGE, so that a source with most documents is many tasks: within a range the next one is a window away, and the last of a range is followed by the first of the next that has any. Only two ids a range and source meet in one task.
    """
    rows = docs.select(F.col(by).alias("_s"), F.col(ident).alias("a"), F.floor(F.col(ident) / RANGE).alias("_r")).where("a is not null")
    inner = rows.select("a", F.lead("a").over(Window.partitionBy("_s", "_r").orderBy("a")).alias("b"))
    edge = rows.groupBy("_s", "_r").agg(F.max("a").alias("a"), F.min("a").alias("first"))
    outer = edge.select("a", F.lead("first").over(Window.partitionBy("_s").orderBy("_r")).alias("b"))
    return inner.union(outer).where("b is not null")


def pixel_size(points: Column, dpi: Column) -> Column:
    return F.greatest(points * F.least(F.greatest(dpi, F.lit(1)), F.lit(2400)) / 72, F.lit(0)).cast("int")


def worker_cap(width: Column, height: Column, max_mb: int, workers: int) -> Column:
    """Workers that the largest page's two rasters leave room for."""
    page = width.cast("long") * height * 4
    return F.when(page <= 0, 1).otherwise(F.least(F.greatest(F.floor(F.lit(max_mb << 20) / (8.0 * page / 4)), F.lit(1)), F.lit(workers)))


def largest_page(pages: DataFrame, *by: str) -> DataFrame:
    """Per pair, of pages (width, height) of both documents: the most bytes a raster takes."""
    return pages.groupBy(*by).agg(F.max(F.col("width").cast("long") * F.col("height") * 4).alias("bytes"))


def paired(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Renders (key, value, err) of either side by page: x, y, and err where either failed or is missing; a failed side drops its partner's value."""
    both = left.select(*key, F.col("value").alias("x"), F.col("err").alias("_l"), F.lit(True).alias("_a")).join(right.select(*key, F.col("value").alias("y"), F.col("err").alias("_r"), F.lit(True).alias("_b")), list(key), "full")
    gone = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit("page is missing on one side"))
    err = F.coalesce("_l", "_r", gone)
    return both.select(*key, F.when(err.isNull(), F.col("x")).alias("x"), F.when(err.isNull(), F.col("y")).alias("y"), err.alias("err"))
