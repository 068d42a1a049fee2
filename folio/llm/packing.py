"""Best-fit packing (operator 7): Martello-Toth dominance reduction, then best fit.

The pieces' lengths are whole numbers up to the capacity, so an instance of any
size is a histogram of at most `size` counters. The driver plans on that alone:
the plan is a list of patterns (lengths that share a sequence) with multiplicities,
and each step that makes one uses up a length or a group of open sequences, so
its size is bounded by the capacity too. Pieces then get their places by rank
among those of their length; ranks are counted within hashed buckets, so that one
frequent length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.bpe import token_pieces
from folio.llm.common import released, written

BUCKETS = 256


def reduce_dominated(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets of at most three pieces which dominate every other set with their longest piece: some best packing has them. left: counts by length; what is fixed is taken off."""
    size = len(left) - 1
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(*lengths: int) -> None:
        times = min(int(left[x]) // lengths.count(x) for x in lengths)
        fixed.append((lengths, times))
        for x in lengths:
            left[x] -= times

    def others(x: int, most: int, n: int) -> list[int]:
        """The n shortest pieces besides one of length x."""
        out: list[int] = []
        for y in np.flatnonzero(left[: most + 1]):
            out += [int(y)] * min(n - len(out), int(left[y]) - (y == x))
            if len(out) >= n:
                break
        return out

    changed = True
    while changed:
        changed = False
        for x in range(size, 0, -1):
            while left[x] > 0:
                room = size - x
                small = others(x, size, 3)
                fit = int(np.searchsorted(np.cumsum(small), room, "right"))
                if fit == 0:
                    fix(x)
                    changed = True
                    continue
                best = next(y for y in range(room, 0, -1) if left[y] > (y == x))
                if fit == 1 or best == room:
                    fix(x, best)
                    changed = True
                    continue
                if fit > 2:
                    break
                pair = _best_pair(left, x, room)
                if pair is None or best >= sum(pair):
                    fix(x, best)
                    changed = True
                    continue
                a, b = pair
                above = np.flatnonzero(left[b + 1 : room // 2 + 1])
                if a == best and not len(above):
                    fix(x, a, b)
                    changed = True
                    continue
                break
    return fixed


def _best_pair(left: np.ndarray, x: int, room: int) -> tuple[int, int] | None:
    """Two pieces a >= b besides x with the largest sum within room, a as large as can be."""
    have = left.copy()
    have[x] -= 1
    lengths = [int(y) for y in np.flatnonzero(have[:room] > 0)]
    best, i, j = None, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[j], lengths[i]
        if a + b > room or (i == j and have[a] < 2):
            j -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        i += 1
    return best


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest open sequence that still holds it; equal sequences move together."""
    size = len(left) - 1
    open_: list[list[list]] = [[] for _ in range(size + 1)]  # by room left: [lengths, times]
    for x in range(size, 0, -1):
        todo, room = int(left[x]), x
        while todo and room <= size:
            if not open_[room]:
                room += 1
                continue
            group = open_[room].pop()
            n = min(group[1], todo)
            if group[1] > n:
                open_[room].append([group[0], group[1] - n])
            open_[room - x].append([(*group[0], x), n])
            todo -= n
            room = min(room, max(room - x, x))
        if todo:
            each = size // x
            if n := todo // each:
                open_[size - each * x].append([(x,) * each, n])
            if todo % each:
                open_[size - todo % each * x].append([(x,) * (todo % each), 1])
    left[:] = 0
    return [(tuple(g), n) for groups in open_ for g, n in groups]


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicities for counts by length (1 to size)."""
    left = np.zeros(size + 1, np.int64)
    for k, v in counts.items():
        left[k] += v
    return [x for x in reduce_dominated(left) + best_fit(left) if x[1]]


def placements(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) for runs of ranks."""
    runs: dict[int, list] = {}
    used, base = np.zeros(size + 1, np.int64), 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            runs.setdefault(x, []).append((int(used[x]), base, at))
            used[x] += times
            at += x
        base += times
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (with doc_id, piece, length from 1 to size).

    No pieces: no rows. Pieces that repeat are packed as often as they occur; equal pieces may swap their places. Columns besides pass through.
    """
    pieces = written(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    runs = placements(plan(counts, size), size)
    cols = pieces.columns
    with_bucket = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    before = with_bucket.groupBy("length", "_bucket").count()
    before = before.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    order = [F.col(c) for c in ("doc_id", "piece", *sorted(set(cols) - {"doc_id", "piece", "length"}))]
    ranked = with_bucket.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
    ranked = ranked.join(before, ["length", "_bucket"]).select(*cols, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            out = np.zeros((2, len(length)), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                run = runs[int(x)]
                at = run[np.searchsorted(run[:, 0], rank[own], "right") - 1]
                out[0, own] = at[:, 1] + rank[own] - at[:, 0]
                out[1, own] = at[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(out[0]), pa.array(out[1])], names=[*cols, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """Token pieces of all documents, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text takes one token, the end id. Documents of more than `size` tokens, however long, are cut into pieces; others stay whole. Null ids are packed as any other; rows that repeat give pieces that repeat, and equal pieces may swap their places. Other columns are not looked at. Empty input: no rows.
    """
    return pack(token_pieces(docs, path, size, end), size)
