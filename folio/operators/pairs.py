"""Similar pairs by exact Jaccard of shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.plans.cut import kept


def shingle_sets(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.shingles(T.tokens(F.col("text"))).alias("s"))


def similar_pairs(docs: DataFrame, percent: int = 50) -> DataFrame:
    """a < b and jaccard of documents with at least that similarity.

    Each document is indexed by its rarest shingles alone, so many that no pair within the threshold can miss each other; a shingle of many documents is rarely among them.
    """
    sets = kept(shingle_sets(docs).select("doc_id", F.transform("s", lambda x: F.xxhash64(x)).alias("h")).where("size(h) > 0"))  # read four times below
    rows = sets.select("doc_id", F.size("h").alias("n"), F.explode("h").alias("x"))
    frequency = rows.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(frequency, "x").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "x")))
    # a prefix shorter by what two sets must share
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("df > 1")
    a, b = prefix.select("x", F.col("doc_id").alias("a"), F.col("n").alias("na")), prefix.select("x", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    near = a.join(b, "x").where(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
    both = near.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
    return both.select("a", "b", T.jaccard(F.col("ha"), F.col("hb")).alias("jaccard")).where(F.col("jaccard") >= percent / 100)


def pair_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the texts of both sides, x and y."""
    t = docs.select("doc_id", "text")
    return pairs.join(t.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(t.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
