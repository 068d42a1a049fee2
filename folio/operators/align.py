"""Alignment of the pages of two documents with different page counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import MIN_SHINGLES, SHINGLE_WORDS

# fixed values
MAX_LCS_CELLS, MAX_GAP_WORK = 4_000_000, 10_000


def common_sequence(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; None equals nothing. Empty where the table would be too large. On a tie, a's item is passed over first."""
    n, m = len(a), len(b)
    if not n or not m or (n + 1) * (m + 1) > MAX_LCS_CELLS or not {*a} & {*b} - {None}:
        return []
    code = {v: i for i, v in enumerate(x for x in dict.fromkeys([*a, *b]) if x is not None)}
    x = np.array([code.get(v, -1) for v in a])
    y = np.array([code.get(v, -2) for v in b])
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        take = np.where(x[i] == y, best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def anchors(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Equal pages in order: common ends, and the common subsequence between them."""
    same = lambda u, v: u is not None and u == v
    low = 0
    while low < min(len(a), len(b)) and same(a[low], b[low]):
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and same(a[-1 - high], b[-1 - high]):
        high += 1
    middle = common_sequence(a[low : len(a) - high], b[low : len(b) - high])
    return [(i, i) for i in range(low)] + [(i + low, j + low) for i, j in middle] + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def gap_pairs(n: int, m: int, like: Callable[[int, int], float] | np.ndarray) -> list[tuple[int, int]]:
    """The shorter side in full, in order, with the highest sum of likeness; the earliest on a tie; by place if there are too many comparisons, or if both are as long, which leaves nothing to choose. like: a function of two places, or its table."""
    if n * m > MAX_GAP_WORK or n == m:
        return [(i, i) for i in range(min(n, m))]
    table = like if isinstance(like, np.ndarray) else np.array([[like(i, j) for j in range(m)] for i in range(n)]).reshape(n, m)
    if n > m:
        return [(i, j) for j, i in gap_pairs(m, n, table.T)]
    best = np.zeros(m + 1)
    left_out = np.zeros((n + 1, m + 1), bool)
    for i in range(1, n + 1):
        paired = np.full(m + 1, -np.inf)
        paired[i:] = best[i - 1 : m] + table[i - 1, i - 1 :]
        best = np.maximum.accumulate(paired)
        left_out[i, i + 1 :] = best[i:-1] >= paired[i + 1 :]
    out, i, j = [], n, m
    while i:
        if not left_out[i, j]:
            i -= 1
            out.append((i, j - 1))
        j -= 1
    return out[::-1]


def align(a: Sequence, b: Sequence, like: Callable[[int, int], float] | None = None, tables: Callable[[slice, slice], np.ndarray] | None = None) -> list[tuple[str, int | None, int | None]]:
    """Rows (kind, p1, p2) of kinds exact, gap, deleted and inserted; pages from 0. Likeness is a function of two places, or of two ranges of them."""
    exact = anchors(a, b)
    out: list[tuple[str, int | None, int | None]] = [("exact", i, j) for i, j in exact]
    i0 = j0 = 0
    for i1, j1 in [*exact, (len(a), len(b))]:
        few = tables and i1 - i0 != j1 - j0 and 0 < (i1 - i0) * (j1 - j0) <= MAX_GAP_WORK
        pairs = gap_pairs(i1 - i0, j1 - j0, tables(slice(i0, i1), slice(j0, j1)) if few else (lambda i, j, i0=i0, j0=j0: like(i0 + i, j0 + j) if like else 0.0))
        out += [("gap", i0 + i, j0 + j) for i, j in pairs]
        used_i, used_j = {i for i, _ in pairs}, {j for _, j in pairs}
        out += [("deleted", i, None) for i in range(i0, i1) if i - i0 not in used_i]
        out += [("inserted", None, j) for j in range(j0, j1) if j - j0 not in used_j]
        i0, j0 = i1 + 1, j1 + 1
    return out


_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
#: All of those scripts and more, for a quick look.
_MAY_BE_UNSPACED = re.compile("[\u0e00-\u11ff\u1780-\u19ff\u2e80-\U0010ffff]")
#: Words kept in a worker's memory; beyond that it starts anew.
CACHE_WORDS = 200_000


class Known(dict):
    """What make gives for a word, worked out once."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self.make(word)
        if len(word) <= 64:
            self[word] = value
        return value


_ENDS, _ALONE = regex.compile(r"^\p{P}+|\p{P}+$"), regex.compile(f"([{_UNSPACED}])")
#: Of words that are not letters and digits alone: without punctuation at their ends. Of words that are not letters alone: whether they are without digits.
_BARE, _PLAIN = Known(lambda w: _ENDS.sub("", w)), Known(lambda w: not any(c.isdecimal() for c in w))


def words_of(text: str) -> list[str]:
    """Tokens of a page, in Python."""
    low = text.lower()
    if _MAY_BE_UNSPACED.search(low):
        low = _ALONE.sub(r" \1 ", low)
    return [w for w in [w if w.isalnum() else _BARE[w] for w in low.split()] if w]


def _runs(words: list[str]) -> frozenset:
    """The shingles of a page, as tuples of their words."""
    if len(words) < SHINGLE_WORDS:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))


_ITEMS, _FEW = 2048, 256


def _common(a: Sequence[frozenset], b: Sequence[frozenset]) -> np.ndarray:
    """The number of items that every set of a has in common with every one of b."""
    both = frozenset().union(*a) & frozenset().union(*b)
    out = np.zeros((len(a), len(b)))
    if not both:
        return out
    a, b = [s & both for s in a], [s & both for s in b]
    if len(a) * len(b) <= _FEW:
        return np.array([[len(s & t) for t in b] for s in a], float)
    code = {x: i for i, x in enumerate(both)}
    at = [[np.array([code[x] for x in s], np.int64) for s in side] for side in (a, b)]
    for first in range(0, len(code), _ITEMS):  # a bounded part of the items at a time
        has = [np.zeros((len(side), _ITEMS), np.float32) for side in at]
        for table, side in zip(has, at, strict=True):
            for i, c in enumerate(side):
                table[i, c[(c >= first) & (c < first + _ITEMS)] - first] = 1
        out += np.rint(has[0] @ has[1].T)
    return out


def _shared(a: Sequence[frozenset], b: Sequence[frozenset]) -> np.ndarray:
    """Jaccard of every set of a with every one of b; 0 without items."""
    common = _common(a, b)
    union = np.array([len(s) for s in a], float)[:, None] + np.array([len(s) for s in b], float)[None, :] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def likeness_table(a: Sequence[list[str]], b: Sequence[list[str]]) -> np.ndarray:
    """Of the words of two runs of pages: exact shingle similarity where either page is long, that of words for short ones, leaving numbers out if both have others."""
    out = np.zeros((len(a), len(b)))
    long = np.zeros(out.shape, bool)
    if any(len(w) - SHINGLE_WORDS + 1 >= MIN_SHINGLES for side in (a, b) for w in side):
        x, y = [_runs(w) for w in a], [_runs(w) for w in b]
        long = np.array([len(s) >= MIN_SHINGLES for s in x])[:, None] | np.array([len(s) >= MIN_SHINGLES for s in y])[None, :]
        if long.any():
            out[long] = _shared(x, y)[long]
    if not long.all():
        x, y = [frozenset(w) for w in a], [frozenset(w) for w in b]
        p, q = ([frozenset(w for w in s if w.isalpha() or _PLAIN[w]) for s in side] for side in (x, y))
        plain = np.array([bool(s) for s in p])[:, None] & np.array([bool(s) for s in q])[None, :]
        for one, two, where in ((x, y, ~long & ~plain), (p, q, ~long & plain)):
            if where.any():
                out[where] = _shared(one, two)[where]
    return out


def text_likeness(a: list[str], b: list[str]) -> float:
    return float(likeness_table([a], [b])[0, 0])


def align_texts(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int | None, int | None]]:
    """align() of pages by their texts; words are made of those pages alone that have a choice of partners."""
    return align(a, b, tables=lambda i, j: likeness_table([words_of(t) for t in a[i]], [words_of(t) for t in b[j]]))


def align_documents(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of documents whose pages are rows (doc_id, page_no, text): a, b, kind, p1, p2 with pages from 1. A task holds the pages of one pair."""
    left = pairs.join(pages.withColumnRenamed("doc_id", "a"), "a").select("a", "b", F.lit(1).alias("side"), "page_no", "text")
    right = pairs.join(pages.withColumnRenamed("doc_id", "b"), "b").select("a", "b", F.lit(2).alias("side"), "page_no", "text")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "page_no"])
        one, two = (pdf.loc[pdf.side == s, "text"].tolist() for s in (1, 2))
        rows = align_texts(one, two)
        out = pd.DataFrame([(pdf.a.iloc[0], pdf.b.iloc[0], k, None if i is None else i + 1, None if j is None else j + 1) for k, i, j in rows], columns=["a", "b", "kind", "p1", "p2"])
        return out.astype({"p1": "Int64", "p2": "Int64"})

    return left.union(right).groupBy("a", "b").applyInPandas(work, "a long, b long, kind string, p1 long, p2 long")
