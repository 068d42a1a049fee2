"""File-level comparison: sizes first, contents only of files of one size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import xxh64


def byte_compare(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of files (id, content): sizes, hashes (0 where sizes differ), identical. Contents of files whose partner has another size are never read into Python."""
    size = files.select("id", F.octet_length("content").cast("long").alias("size"))
    sized = pairs.join(size.withColumnsRenamed({"id": "a", "size": "size1"}), "a").join(size.withColumnsRenamed({"id": "b", "size": "size2"}), "b")
    same = sized.where("size1 = size2")
    ids = same.select(F.col("a").alias("id")).union(same.select(F.col("b").alias("id"))).distinct()
    hashes = files.join(ids, "id", "left_semi").select("id", xxh64(F.col("content")).alias("hash"))
    same = same.join(hashes.withColumnsRenamed({"id": "a", "hash": "hash1"}), "a").join(hashes.withColumnsRenamed({"id": "b", "hash": "hash2"}), "b")
    rest = sized.where("size1 <> size2").withColumn("hash1", F.lit(0).cast("long")).withColumn("hash2", F.lit(0).cast("long"))
    both = same.select("a", "b", "size1", "size2", "hash1", "hash2").union(rest.select("a", "b", "size1", "size2", "hash1", "hash2"))
    return both.withColumn("identical", (F.col("size1") == F.col("size2")) & (F.col("hash1") == F.col("hash2")))
