"""Accuracy reports over labelled cases and verdicts, and small relational operators of the harness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(cases: DataFrame, by: str) -> DataFrame:
    """Per tool, of rows (label, verdict in same, diff, error): a change is a positive, errors are wrong."""
    true, same = F.col("label") == "diff", F.col("label") == "same"
    found, passed = F.col("verdict") == "diff", F.col("verdict") == "same"
    return cases.groupBy(by).agg(
        F.count_if(true & found).alias("tp"), F.count_if(true & ~found).alias("fn"), F.count_if(same & passed).alias("tn"), F.count_if(same & ~passed).alias("fp"), F.count_if(F.col("verdict") == "error").alias("errors"),
        (F.count_if(F.col("label") == F.col("verdict")) / F.count(F.lit(1))).alias("accuracy"),
    )


def missing(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be run."""
    return wanted.join(done, keys, "left_anti")


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """inner (key, start, end) with the outer ranges (key, first, last, name) that hold them."""
    return inner.join(outer, key).where("start >= first and end <= last")


def product(cases: DataFrame, tools: list[str]) -> DataFrame:
    """Every tool on every case: a row each, by an array of the tools' names in the row."""
    return cases.withColumn("tool", F.explode(F.array(*[F.lit(t) for t in tools])))


def merged_coverage(blocks: DataFrame, *span: str) -> DataFrame:
    """One row for each span; hit if any of its blocks was."""
    return blocks.groupBy(*span).agg(F.bool_or("hit").alias("hit"))


def joined_errors(pages: DataFrame, by: str) -> DataFrame:
    """Of pages (page, err), per document: null without an error, else one message that names the pages in order."""
    each = F.array_sort(F.collect_list(F.when(F.col("err").isNotNull(), F.struct("page", "err"))))
    told = F.transform("_e", lambda e: F.concat(F.lit("page "), e["page"].cast("string"), F.lit(": "), e["err"]))
    rows = pages.groupBy(by).agg(each.alias("_e"))
    n = F.size("_e")
    return rows.select(by, F.when(n == 1, told[0]).when(n > 1, F.concat(n.cast("string"), F.lit(" pages failed: "), F.array_join(told, "; "))).alias("message"))
