"""Results as JSON and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import format_bytes


def as_json(results: DataFrame, *keys: str) -> DataFrame:
    return results.select(*keys, F.to_json(F.struct(*[c for c in results.columns])).alias("json"))


def _stats(n: Column, size: Column, opened: Column) -> Column:
    return F.when(opened, F.concat(n.cast("string"), F.lit(" pages, "), format_bytes(size))).otherwise(format_bytes(size))


def _pages(title: str, pages: Column, more: Column | None = None) -> Column:
    line = F.concat(F.lit(f"{title}: ["), F.array_join(pages.cast("array<string>"), " "), F.lit("]"), F.lit("") if more is None else more)
    return F.when(F.size(pages) > 0, line)


def as_text(results: DataFrame, *keys: str) -> DataFrame:
    """keys and text: results of plans.cascade.compare with name1, name2, size1 and size2, for people."""
    c = F.col
    opened = (c("n1") > 0) | (c("n2") > 0) | (c("strategy") == "empty documents")
    lines = [
        F.lit("Comparison"), F.concat(F.lit("File 1: "), c("name1"), F.lit(" ("), _stats(c("n1"), c("size1"), opened), F.lit(")")), F.concat(F.lit("File 2: "), c("name2"), F.lit(" ("), _stats(c("n2"), c("size2"), opened), F.lit(")")),
        F.concat(F.lit("Status: "), c("status")), F.format_string("Similarity: %.1f%%", c("score") * 100), F.concat(F.lit("Bytes: "), F.when(c("status") == "IDENTICAL", "IDENTICAL").otherwise("DIFFERENT")),
        _pages("Modified pages", c("different_pages"), F.when(c("n1") != c("n2"), " (file 1 numbering)").otherwise("")), _pages("Deleted pages (in file 1)", c("deleted")), _pages("Inserted pages (in file 2)", c("inserted")),
    ]
    return results.select(*keys, F.concat_ws("\n", *lines).alias("text"))
