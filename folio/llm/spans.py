"""Repeated windows of a corpus, found by doubling over selected positions.

A window is `length` consecutive units (bytes or words) of one document. Naming
every position of a corpus at every length would shuffle many times its size, so
each round names only selected positions: of all windows that a run of positions
starts, the leftmost smallest `k`-unit substring is their anchor, and equal
windows have equal anchors at equal places. A round sorts anchors by the pair of
their names: that of the k units, and that of the whole run of windows around it
(its context, the longer offset). Names that occur once drop out. Where all
windows of a run occur earlier as the same run, the run is decided as a whole;
the first occurrence of a run whose k units also stand in other contexts goes to
the next round with a larger k, until k is the window itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import SYMBOLS, Rolling, batch_bytes, dropped, lasting, maybe_in, mix, raw, released, scratch, word_hashes, written

#: Units whose hashes are held at once; longer documents are read in overlapping parts.
PART = 1 << 20
#: Bits of a place in a part, with the windows that reach beyond it.
_PLACE = 21
_C = np.uint64(0xA0761D6478BD642F)


def byte_units(text: bytes) -> np.ndarray:
    return SYMBOLS[np.frombuffer(text, np.uint8)]


def word_units(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text, np.uint8))


def _leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its first smallest. The last bits of a value give way to its place, so that the smallest tells where it is; equal windows still choose alike."""
    here = np.uint64((1 << _PLACE) - 1)
    low = (v & ~here) | np.arange(len(v), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: span - width], low[width - span :])
    return (low & here).astype(np.int64)


def run_names(units: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Names of runs of windows by all their units; from other symbols than the names of anchors, so that both together have 128 bits."""
    return Rolling(mix(units ^ _C)).of(at, at + n + length - 1)


def anchors(units: np.ndarray, length: int, k: int, wanted: np.ndarray | None = None, only_names: bool = False) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: name of its k units, name of the run, first window, number of windows; or the names of the k units alone. wanted: a flag for each window."""
    parts = []
    n = len(units) - length + 1
    for a in range(0, n, PART):
        b = min(a + PART, n)
        if wanted is not None and not wanted[a:b].any():
            continue
        part = Rolling(units[a : b + length - 1])
        names = part.windows(k)
        at = _leftmost_minimum(names, length - k + 1)
        on = np.ones(b - a, bool) if wanted is None else wanted[a:b]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (on[1:] != on[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, b - a))
        keep = on[first]
        first, count = first[keep], count[keep]
        h = names[at[first]]
        if only_names:
            parts.append((h,))
            continue
        run = run_names(units[a : b + length - 1], first, count, length)
        parts.append((h, run, first + a, count))
    if not parts:
        z = np.zeros(0, np.uint64)
        return (z,) if only_names else (z, z, np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _names(docs: DataFrame, units: Callable[[bytes], np.ndarray], length: int, k: int) -> DataFrame:
    """The names (h) of the k units of the anchors of documents (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = (units(raw(t.as_py())) for t in batch.column(1))
            out = [anchors(u, length, k, only_names=True)[0] for u in found if len(u) >= length]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["h"])

    return docs.mapInArrow(work, "h long")


def _rows(docs: DataFrame, units: Callable[[bytes], np.ndarray], length: int, k: int) -> DataFrame:
    """Anchors of documents (doc_id, text[, spans])."""
    narrow = "spans" in docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            out = []
            for r in range(batch.num_rows):
                u = units(raw(batch.column(1)[r].as_py()))
                wanted = None
                if len(u) < length:
                    continue
                if narrow:
                    spans = batch.column(2)[r].values
                    wanted = covered(spans.field(0).to_numpy(), spans.field(1).to_numpy(), len(u) - length + 1)
                h, run, at, n = anchors(u, length, k, wanted)
                out.append((h, run, np.full(len(h), batch.column(0)[r].as_py(), np.int64), at, n))
            if out:
                h, run, i, at, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(run.view(np.int64)), pa.array(i), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "run", "doc_id", "at", "n"])

    return docs.mapInArrow(work, "h long, run long, doc_id long, at int, n int")


def covered(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Flags of the places at .. at + n of each span."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.minimum(at, size), 1)
    np.add.at(change, np.minimum(at + n, size), -1)
    return np.cumsum(change[:-1]) > 0


def repeated(docs: DataFrame, units: Callable[[bytes], np.ndarray], length: int, steps: tuple[int, ...], within: bool) -> DataFrame:
    """Runs of windows (doc_id, at, n: first window and their number) that occur earlier, as they are: with `within`, in a document with a smaller id or earlier in the same one, and the run's name; else only in a document with a smaller id, with its first occurrence (document src, place sat). Runs of a document don't overlap. steps: the k of each round, the last equal to length."""
    more = [F.col("run")] if within else [F.col("first.doc_id").alias("src"), F.col("first.at").alias("sat")]
    todo, found = docs, []
    for k in steps:
        # the first round's anchors are cheaper to find again than to keep; later rounds would shuffle their texts again
        rows = _rows(todo, units, length, k) if todo is docs else written(_rows(todo, units, length, k))
        # written, so that the join has an exchange on either side and can split a frequent name
        names = _names(docs, units, length, k) if todo is docs else rows
        often = written(names.groupBy("h").count().where("count > 1").select("h"))
        mine = written(rows.join(often, "h"))
        first = mine.groupBy("h", "run").agg(F.min(F.struct("doc_id", "at")).alias("first"))
        first = first.withColumnRenamed("h", "_h").withColumnRenamed("run", "_run")
        branching = first.groupBy("_h").agg(F.count(F.lit(1)).alias("_runs"))
        first = first.join(branching.withColumnRenamed("_h", "_h2"), F.col("_h") == F.col("_h2")).drop("_h2")
        joined = mine.join(first, (F.col("h") == F.col("_h")) & (F.col("run") == F.col("_run")))
        later = F.struct("doc_id", "at") > F.col("first") if within else F.col("doc_id") > F.col("first.doc_id")
        told = written(joined.select("doc_id", "at", "n", *more, later.alias("later"), (F.col("_runs") > 1).alias("branching")).where("later or branching"))
        dropped(mine, often, *([] if todo is docs else [rows]))
        found.append(told.where("later").drop("later", "branching"))
        if k == length:
            break
        refine = told.where("not later and branching").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
        refine = written(refine)
        todo = maybe_in(docs, refine).join(refine, "doc_id").select("doc_id", "text", "spans")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def paths(runs: DataFrame) -> DataFrame:
    """Runs that follow each other in their document as well as in the source, joined to one: doc_id, at, n, src, sat.

    A run ends in a node. The node has one way in and one way out if a run of the same document starts there and goes on at the source's next place: a join of runs with the runs before and after them leaves those that begin or end a path. Along a document and a source, at one distance from each other, the first that begins belongs to the first that ends, and so on.
    """
    line = ["doc_id", "src", "shift"]
    each = written(runs.withColumn("shift", F.col("sat") - F.col("at")).withColumn("end", F.col("at") + F.col("n")).select(*line, "at", "end"))
    order = lambda c: F.row_number().over(Window.partitionBy(*line).orderBy(c)).alias("i")
    begins = each.join(each.select(*line, F.col("end").alias("at")), [*line, "at"], "left_anti").select(*line, "at", order("at"))
    ends = each.join(each.select(*line, F.col("at").alias("end")), [*line, "end"], "left_anti").select(*line, "end", order("end"))
    out = written(begins.join(ends, [*line, "i"]).where("end > at").select("doc_id", "at", (F.col("end") - F.col("at")).alias("n"), "src", (F.col("at") + F.col("shift")).alias("sat")))
    dropped(each)
    return out


def checked(docs: DataFrame, found: DataFrame, digest: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """Per document with such paths: doc_id, spans (at, n, digest): what stands at the source's coordinates, of which `digest` makes 128 bits. A span is to go only where the document has the same."""
    asked = written(found.select("src", "sat", "n").distinct().groupBy("src").agg(F.collect_list(F.struct("sat", "n")).alias("spans")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            out: list[tuple] = []
            for r in range(batch.num_rows):
                spans = batch.column(2)[r].values
                at, n = spans.field(0).to_numpy(), spans.field(1).to_numpy()
                i = batch.column(0)[r].as_py()
                out += [(i, int(x), int(y), d) for x, y, d in zip(at, n, digest(raw(batch.column(1)[r].as_py()), at, n), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["src", "sat", "n", "digest"])

    sources = maybe_in(docs.withColumnRenamed("doc_id", "src"), asked, "src").join(asked.hint("merge"), "src")
    # of rows that repeat an id, whichever is longest there; a document that differs keeps its text
    told = written(sources.select("src", "text", "spans").mapInArrow(work, "src long, sat int, n int, digest binary").groupBy("src", "sat", "n").agg(F.max("digest").alias("digest")))
    out = found.join(told, ["src", "sat", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "digest")).alias("spans"))
    return lasting(out)


def _word_digests(words: list[bytes], at: np.ndarray, n: np.ndarray, length: int) -> list[bytes]:
    return [hashlib.blake2b(b" ".join(words[a : a + k + length - 1]), digest_size=16).digest() for a, k in zip(at.tolist(), n.tolist(), strict=True)]


def _same(spans: pa.StructArray | None, of: Callable[[np.ndarray, np.ndarray], list], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the spans that lie within the text and hold what they are said to: first windows and their numbers. most: the text's windows."""
    if spans is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, n = spans.field(0).to_numpy().astype(np.int64), spans.field(1).to_numpy().astype(np.int64)
    fits = np.flatnonzero(at + n <= most)
    said = spans.field(2).to_pylist()
    same = fits[np.array([x == said[i] for i, x in zip(fits, of(at[fits], n[fits]), strict=True)], bool)]
    return at[same], n[same]


def plain(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def _with_spans(docs: DataFrame, spans: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work over all documents: those that the bounded filter rules out have no spans and are not shuffled."""
    hit = maybe_in(docs, spans).join(spans.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans")
    rest = maybe_in(docs, spans, how="left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return hit.mapInArrow(work, schema).union(rest.mapInArrow(work, schema))


def _spans_at(batch: pa.RecordBatch, r: int) -> pa.StructArray | None:
    value = batch.column(2)[r]
    return value.values if value.is_valid else None


def remove_bytes(docs: DataFrame, length: int = 100, steps: tuple[int, ...] = (32, 72, 100), keep_spans: bool = False) -> DataFrame:
    """Operator 2, suffix-array dedup: per row of docs doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, with keep_spans, `removed`: start and end of each removed run).

    A byte goes if a window of `length` bytes covers it that also starts earlier. Equality is that of 128 bits: the anchor's name and the run's. Null and empty texts, and texts shorter than a window, keep all. A document without an id keeps all and is nobody's earlier occurrence. Rows that repeat an id are taken to be one document, and each gets its result; where their texts differ, a span goes only where a row's own bytes have its name. Long texts are read in overlapping parts. Empty input: no rows.
    """
    docs = plain(docs)
    batch_bytes(docs.sparkSession)
    with scratch():
        known = docs.where("doc_id is not null")
        spans = lasting(repeated(known, byte_units, length, steps, True).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "run")).alias("spans")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            out = []
            for r in range(batch.num_rows):
                text = raw(batch.column(1)[r].as_py())
                a = np.frombuffer(text, np.uint8)
                at, n = _same(_spans_at(batch, r), lambda x, y, text=text: run_names(byte_units(text), x, y, length).view(np.int64).tolist(), len(a) - length + 1)
                gone = covered(at, n + length - 1, len(a))
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                out.append((batch.column(0)[r].as_py(), len(a), int(gone.sum()), len(runs), hashlib.sha256(a[~gone].tobytes()).hexdigest(), [{"start": s, "end": e} for s, e in runs]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))][: 5 + keep_spans]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"][: 5 + keep_spans]
    return _with_spans(docs, spans, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed array<struct<start: long, end: long>>" * keep_spans)


def remove_words(docs: DataFrame, length: int = 13, steps: tuple[int, ...] = (5, 13), keep_text: bool = False) -> DataFrame:
    """Operator 9, substring dedup by De Bruijn compaction: per row of docs doc_id, n_words, n_removed, kept_sha256 (and, with keep_text, the kept words).

    Windows of `length` words are the edges of a graph whose nodes are the `length` - 1 words that two windows share. Edges are dealt by the smallest hash of the k words within, so that neighbours stay together: a run of them is one long edge. Where a bucket holds but one run, the graph does not branch within, and the run is decided whole; other runs are taken apart into their edges. Decided runs become paths, and a path's words are compared with those at its source's coordinates (see paths and checked). A word goes if a window covers it that also starts in a document with a smaller id.

    Null, empty and short texts keep all words. A document without an id keeps all and is nobody's earlier occurrence. Rows that repeat an id are taken to be one document; where their texts differ, only words that equal the source's go. Long texts are read in overlapping parts. Empty input: no rows.
    """
    docs = plain(docs)
    batch_bytes(docs.sparkSession)
    with scratch():
        known = docs.where("doc_id is not null")
        spans = checked(known, paths(repeated(known, word_units, length, steps, False)), lambda text, at, n: _word_digests(text.split(), at, n, length))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            out = []
            for r in range(batch.num_rows):
                words = raw(batch.column(1)[r].as_py()).split()
                at, n = _same(_spans_at(batch, r), lambda x, y, words=words: _word_digests(words, x, y, length), len(words) - length + 1)
                gone = covered(at, n + length - 1, len(words))
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)] if gone.any() else words)
                out.append((batch.column(0)[r].as_py(), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + keep_text], strict=False)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + keep_text])

    return _with_spans(docs, spans, work, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text)
