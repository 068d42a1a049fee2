"""Quality classifier (operator 6): histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver on a bounded sample of labelled rows
(MAX_TRAIN, by hash of the id); statistics and scores cover every whole text. A
fitted model is five flat arrays; all rows of a batch walk down a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import batch_bytes, raw, word_bounds, Rolling, SYMBOLS, released

#: The most labelled rows that a fit reads.
MAX_TRAIN = 20_000
THRESHOLD = 0.7
STATS = ("log_bytes", "lower", "upper", "digit", "wide", "blank", "newline", "stop", "bang", "bar", "sign", "quote", "log_words", "word_mean", "word_sd", "distinct", "top_word", "repeats", "bigrams", "upper_words", "signed_words", "log_lines", "line_mean", "distinct_lines", "stop_lines")

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"|", b"*#$%&@^~=+<>{}[]\\/_", b"'\"()-`"), 1):
    _CLASS[list(_chars)] = _i


def statistics(text: str | None) -> np.ndarray:
    """Of one whole text; an empty one has zeros."""
    out = np.zeros(len(STATS))
    a = np.frombuffer(raw(text), np.uint8)
    n = len(a)
    if not n:
        return out
    kinds = _CLASS[a]
    out[0] = np.log1p(n)
    out[1:12] = np.bincount(kinds, minlength=12)[1:12] / n
    start, end = word_bounds(a)
    w = len(start)
    if w:
        h = Rolling(SYMBOLS[a]).of(start, end)
        length = end - start
        _, c = np.unique(h, return_counts=True)
        out[12:17] = np.log1p(w), length.mean(), length.std(), len(c) / w, c.max() / w
        out[17] = np.count_nonzero(h[1:] == h[:-1]) / w
        out[18] = len(np.unique(h[1:] * np.uint64(3) + h[:-1])) / max(1, w - 1)
        first, last = kinds[start], kinds[end - 1]
        inner = kinds[np.minimum(start + 1, end - 1)]
        out[19] = np.count_nonzero((first == 2) & (inner == 2)) / w
        out[20] = np.count_nonzero((last == 7) | (last == 9) | (last == 10)) / w
    breaks = np.flatnonzero(a == 10)
    lines = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [n]))
    h = Rolling(SYMBOLS[a]).of(*lines)
    out[21] = np.log1p(len(h))
    out[22] = n / len(h)
    out[23] = len(np.unique(h)) / len(h)
    ends = a[np.maximum(lines[1] - 1, 0)]
    out[24] = np.count_nonzero((ends == 46) | (ends == 33) | (ends == 63)) / len(h)
    return out


@dataclass
class Trees:
    """Flat arrays over all nodes of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Logistic loss; one tree after another, level by level, on histograms of gradients. Without labels, or with one label only, the score is a constant."""
    mean = float(y.mean()) if len(y) else 1.0
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    f, t, lo, hi, v, roots = [], [], [], [], [], []
    base = float(np.log(mean / (1 - mean)))
    if len(y) and 0 < y.sum() < len(y):
        d = x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
        score = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            roots.append(len(f))
            node = np.full(len(y), len(f))
            level = [len(f)]
            for a in (f, t, lo, hi, v):
                a.append(0)
            for step in range(depth + 1):
                index = {k: i for i, k in enumerate(level)}
                alive = np.isin(node, level)
                own, where = np.flatnonzero(alive), None
                where = np.array([index[k] for k in node[own]], int) if len(own) else np.zeros(0, int)
                gs, hs, ns = (np.bincount(where, z, len(level)) for z in (g[own], h[own], np.ones(len(own))))
                following = []
                best = [(1e-6, None)] * len(level)
                if step < depth:
                    for j in range(d):
                        if not len(edges[j]):
                            continue
                        size = len(edges[j]) + 1
                        flat = where * size + code[own, j]
                        gl, hl, nl = (np.cumsum(np.bincount(flat, z, len(level) * size).reshape(len(level), size), 1)[:, :-1] for z in (g[own], h[own], np.ones(len(own))))
                        gain = gl**2 / (hl + l2) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + l2) - (gs**2 / (hs + l2))[:, None]
                        gain[(nl < least) | (ns[:, None] - nl < least)] = -1
                        at = gain.argmax(1)
                        for i in range(len(level)):
                            if gain[i, at[i]] > best[i][0]:
                                best[i] = (gain[i, at[i]], (j, edges[j][at[i]]))
                for i, k in enumerate(level):
                    if best[i][1] is None:
                        f[k], t[k], lo[k], hi[k], v[k] = 0, np.inf, k, k, rate * gs[i] / (hs[i] + l2)
                        continue
                    f[k], t[k] = best[i][1]
                    lo[k], hi[k] = len(f), len(f) + 1
                    for a in (f, t, lo, hi, v):
                        a += [0, 0]
                    following += [lo[k], hi[k]]
                    rows = own[where == i]
                    node[rows] = np.where(x[rows, f[k]] <= t[k], lo[k], hi[k])
                level = following
                if not level:
                    break
            score += np.array(v)[node]
    return Trees(np.array(f, int), np.array(t, float), np.array(lo, int), np.array(hi, int), np.array(v, float), np.array(roots, int), depth, base)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit reads."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> Trees:
    """On at most `most` labelled documents outside the held-out part. Null ids and labels are left out, as are documents without a label; a document labelled twice counts by its larger label."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    schema = "i long, y int, " + ", ".join(f"x{i} double" for i in range(len(STATS)))

    def measure(frames):
        for pdf in released(frames):
            rows = [statistics(t) for t in pdf["text"]]
            out = pd.DataFrame(np.array(rows).reshape(len(rows), len(STATS)), columns=[f"x{i}" for i in range(len(STATS))])
            out.insert(0, "y", pdf["_y"].to_numpy())
            out.insert(0, "i", pdf["doc_id"].to_numpy())
            yield out

    batch_bytes(spark)
    sample = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(known), "doc_id").select("doc_id", "_y", "text")
    # one row of an id, so that rows that repeat it do not add to what the driver gets
    told = sample.mapInPandas(measure, schema).groupBy("i").agg(F.max(F.struct(*[f.split()[0] for f in schema.split(", ")[1:]])).alias("s")).select("s.*")
    pdf = told.toPandas()  # bounded: `most` rows of statistics
    pdf = pdf.sort_values(list(pdf.columns)).reset_index(drop=True)
    return fit(pdf.iloc[:, 1:].to_numpy(float), pdf["y"].to_numpy(float))


def score_column(model: Trees, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.stack([statistics(t) for t in texts])))

    return score(text)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Null and empty texts get the score of a text with all statistics 0; null ids are not held out; repeated rows stay."""
    model = train(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, whatever their names, which the classifier accepts.

    Null and empty texts are scored as texts without words; null ids and repeated rows are scored as any other; long texts are measured whole. Ties with the threshold are accepted. Empty input: no rows.
    """
    batch_bytes(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score_column(train(docs, labels), F.col("text").cast("string")).alias("score"))
    return rows.where(F.col("score") >= threshold).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
