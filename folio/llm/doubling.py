"""Prefix doubling over all byte positions: the plain form of operator 2's method.

Every position starts with the rank of its first eight bytes. A round joins each
position with the one `reach` bytes on, sorts the pairs of ranks, drops what is
unique, and gives the rest their pair's place in the order as new rank; the last
round's offset is such that the pair covers the window. A position per byte is
shuffled in each round, so this is for small tables and as a measure: the query
runs on selected positions (spans.py). What it costs is in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import batch_bytes, dropped, raw, written

_FIRST = 8


def _positions(docs: DataFrame) -> DataFrame:
    """doc_id, at, rank: a row for each place with eight bytes before the end, and those bytes as a number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a = np.frombuffer(raw(batch.column(1)[r].as_py()), np.uint8)
                n = len(a) - _FIRST + 1
                if n > 0:
                    rank = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, _FIRST)).view(">u8").ravel().astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[r].as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array((rank ^ np.uint64(1 << 63)).view(np.int64))], names=["doc_id", "at", "rank"])

    return docs.mapInArrow(work, "doc_id long, at int, rank long")


def repeated_windows(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, at of windows of `length` bytes (8 at least) of documents (doc_id, text) that start earlier too: in a document with a smaller id, or in the same one. Null and short texts have none; rows without an id are left out; rows that repeat an id are taken to be one document. Empty input: no rows."""
    batch_bytes(docs.sparkSession)
    rows = written(_positions(docs.where("doc_id is not null")))
    reach = _FIRST
    while True:
        offset = min(reach, length - reach)
        after = rows.select("doc_id", (F.col("at") - offset).alias("at"), F.col("rank").alias("next"))
        pairs = written(rows.join(after, ["doc_id", "at"]))  # a unique place after makes the pair unique
        shared = pairs.groupBy("rank", "next").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        order = written(shared.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").select("rank", "next", "first", F.monotonically_increasing_id().alias("new")))
        named = pairs.join(order, ["rank", "next"])
        dropped(rows)
        reach += offset
        if reach >= length:
            out = written(named.where(F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at"))
            dropped(pairs, order)
            return out
        rows = written(named.select("doc_id", "at", F.col("new").alias("rank")))
        dropped(pairs, order)
