"""Mixing sources to target weights (operator 8).

Documents get hash-random keys and are sorted by them within their source; a
distributed prefix sum of sizes cuts each source at its budget. The key's first
digits deal a source's rows into ranges of equal width, which are sorted and
summed apart: a source with a third of all rows is no task of its own. Budgets
beyond the source repeat it in whole epochs; the document on the cut gives the
words that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, lasting, scratch, written

WEIGHTS = (5, 2, 1)
#: Ranges of keys in each source: hex digits of the key.
DIGITS = 3


SIZE = f"cast(coalesce(regexp_count(text, '{WORD.replace(chr(92), chr(92) * 2)}'), 0) as long)"


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size (words), key."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", f"{SIZE} size").withColumn("key", key)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source: source, source_size, target. Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops at `most` times its source, and the excess goes to the others by weight.

    Who stops is known from the ratio of that limit to the weight: in ascending order, a source stops while its ratio is below the share of a unit of weight that the rest would have. There is one row for each source, so these windows have as many rows as there are sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("unit", F.col("left").cast("double") / F.col("left_w").cast("double"))
    stops = F.col("cap").cast("double") / F.col("w").cast("double") < F.col("unit")
    unit = F.first(F.when(~stops, F.col("unit")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("unit", unit)
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w").cast("double") * F.col("unit")).alias("target"))


def takes(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """Adds source_size, target and taken (words, over all epochs) to the rows of sized."""
    sized = sized.withColumn("_range", F.substring("key", 1, DIGITS)).withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    goal = goal.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), "source_size", "target")
    ranges = sized.groupBy("_s", "_range").agg(F.sum("size").alias("_n"))
    ranges = ranges.select("_s", "_range", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_range")) - F.col("_n")).alias("_before"))
    ranges = ranges.join(goal, "_s")
    within = F.sum("size").over(Window.partitionBy("_s", "_range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    all_ = sized.withColumn("_upto", within).join(ranges, ["_s", "_range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_before") + F.col("_upto") - F.col("size"))))
    return all_.select("doc_id", "source", "size", "key", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken.

    A null text has size 0 and is taken 0 words of; the null source is a source of its own, after the others. Without rows: no rows. Rows that repeat count as often as they occur.
    """
    sized = written(sizes(docs))
    return takes(sized, targets(sized)).drop("key")


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def cuts(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """One row for each source: its epochs, and the last document of the last epoch with the words it gives; of rows that repeat that document, with the words they give together."""
    order = F.struct("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "size")
    t = takes(sized, goal)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    part = F.col("taken") - epochs * F.col("size")
    t = t.select(_source(F.col("source")).alias("_s"), epochs.alias("_epochs"), order.alias("at"), part.alias("words"))
    t = t.groupBy("_s", "at").agg(F.max("_epochs").alias("_epochs"), F.sum("words").alias("words"))
    return t.groupBy("_s").agg(F.max("_epochs").alias("_epochs"), F.max(F.when(F.col("words") > 0, F.struct("at", "words"))).alias("_last"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The mix itself: rows of docs with all their columns, whatever their names, one for each time a document is taken. The document on a source's cut gives its first words, joined by one space.

    Only the cuts, a row for each source, are joined to the texts. Documents without words, and null texts, cost nothing and are kept once. Of rows that repeat the document on the cut, one after another (by the hash of the text) gives its words until the budget is met. The null source is a source of its own. Long texts are counted whole. Empty input: no rows.
    """
    cols = docs.columns
    with scratch():
        sized = written(sizes(docs))
        at = lasting(cuts(sized, targets(sized, weights, most)))
    doc_id = F.coalesce(F.col("_d.doc_id").cast("long"), F.lit((1 << 63) - 1))
    key = F.md5(F.concat(F.coalesce(F.col("_d.doc_id").cast("long").cast("string"), F.lit("")), F.lit("/mix")))
    size = F.expr(SIZE.replace("(text,", "(cast(_d.text as string),"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_d"))
    rows = rows.select("_d", _source(F.col("_d.source")).alias("_s"), doc_id.alias("_i")).join(at, "_s")
    here = F.struct(key.alias("key"), F.col("_i").alias("doc_id"), size.alias("size")).alias("_at")
    same = F.coalesce(F.col("_i") == F.col("_last.at.doc_id"), F.lit(False))
    others = rows.where(~same).select("_d", "_s", "_epochs", "_last", here)
    others = others.withColumn("_words", F.when(F.coalesce(F.col("_at") < F.col("_last.at"), F.lit(False)), F.col("_at.size")).otherwise(0).cast("long"))
    # the rows of one id in each source: before the cut, on it or after
    tied = rows.where(same).select("_d", "_s", "_epochs", "_last", here)
    i = F.row_number().over(Window.partitionBy("_s", "_at").orderBy(F.xxhash64("_d.text")))
    on = F.least(F.greatest(F.col("_last.words") - (i - 1) * F.col("_at.size"), F.lit(0)), F.col("_at.size"))
    tied = tied.withColumn("_on", on).withColumn("_words", F.when(F.col("_at") < F.col("_last.at"), F.col("_at.size")).when(F.col("_at") == F.col("_last.at"), F.col("_on")).otherwise(0).cast("long")).drop("_on")
    rows = others.unionByName(tied)
    part = (F.col("_words") > 0) & (F.col("_words") < F.col("_at.size"))
    times = F.when(F.col("_at.size") == 0, 1).otherwise(F.col("_epochs") + (F.col("_words") > 0).cast("int")).cast("int")
    rows = rows.where(times > 0).withColumn("_e", F.explode(F.sequence(F.lit(1), times))).withColumn("_cut", part & (F.col("_e") == times))
    text = F.col("_d.text")
    head = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.greatest(F.col("_words"), F.lit(1)).cast("int")), " ")
    return rows.select(*[F.when(F.col("_cut"), head).otherwise(text).alias("text") if c == "text" else F.col(f"_d.`{c}`").alias(c) for c in cols])
