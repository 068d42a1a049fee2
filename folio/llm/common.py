"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the fixed-size id filter that may be broadcast; 2 MB whatever the input.
FILTER_WORDS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset (local tests), one below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut"


#: Tables written within scratch(), if that is open.
_OPEN: ContextVar[list[DataFrame] | None] = ContextVar("open", default=None)


def lasting(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that later plans neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def written(df: DataFrame) -> DataFrame:
    """lasting(), but deleted where the scratch() that is open ends."""
    out = lasting(df)
    if (tables := _OPEN.get()) is not None:
        tables.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what is written() within, at the end. What is to be read later must be lasting()."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        tables = _OPEN.get()
        _OPEN.reset(token)
        dropped(*tables)


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by written() which no later plan reads."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, df._cut_path
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def batch_bytes(spark: SparkSession, mb: int = 8) -> None:
    """Bound the bytes of text that one Arrow batch brings to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def released(batches: Iterator) -> Iterator:
    """The batches of a task. At its end the Python worker, which waits for the next task while the JVM works, gives back the memory that its allocators hold."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def id_filter(ids: DataFrame, col: str) -> DataFrame:
    """A bitmap of hashed ids of fixed size (at most FILTER_WORDS rows of 64 bits). It may let others pass, never loses an id: an exact join must follow."""
    h = F.xxhash64(F.col(col))
    return ids.select(F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).alias("_fw"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({col}), 64) as int))").alias("_fb")).groupBy("_fw").agg(F.bit_or("_fb").alias("_fb"))


def maybe_in(df: DataFrame, ids: DataFrame, col: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of df whose id may be among ids (with left_anti: surely is not; null ids are not): a broadcast of bounded size keeps most other rows, and their texts, out of the exact join's shuffle."""
    f = F.broadcast(id_filter(ids, col))
    h = F.xxhash64(df[col])
    on = (F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)) == f["_fw"]) & (F.call_function("shiftright", f["_fb"], F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return df.join(f, on & df[col].isNotNull(), how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), by alternating large-star and small-star steps until nothing changes: rows (id, comp), comp the smallest id reachable. Only ids with an edge to another appear."""
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    old = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small)
        now = tuple(new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        dropped(e)
        e = new
        if now == old:
            break
        old = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


# -- hashes of byte and word sequences, the same on every machine -----------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POW = _powers(1 << 14)
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW
    if len(_POW[0]) < n:
        _POW = _powers(max(n, 2 * len(_POW[0])))
    return _POW[0][:n], _POW[1][:n]


class Rolling:
    """Polynomial hashes of any slice of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Of each run of k symbols."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k)) if n > 0 else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(a: np.ndarray) -> np.ndarray:
    start, end = word_bounds(a)
    return Rolling(SYMBOLS[a]).of(start, end) if len(start) else np.zeros(0, np.uint64)


def raw(text: str | None) -> bytes:
    return text.encode() if text else b""
