"""Text functions: column builders where SQL can say it, vectorised Python elsewhere."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

# fixed values
MINHASH_SLOTS = 128
SHINGLE_WORDS = 3
MIN_SHINGLES = 60
INVISIBLE = "­​‌‍⁠﻿"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
_MIX1, _MIX2, _STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; invisible characters dropped."""
    return F.trim(F.regexp_replace(F.translate(text, INVISIBLE, ""), r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """NFKC, then spaced. Texts of ASCII alone skip Python's part only in the plan of the caller: see operators.pages."""
    return spaced(compatible(text))


def bag(text: Column) -> Column:
    """The counted characters, sorted: ASCII letters and digits, and letters and digits beyond U+02FF."""
    return F.array_join(F.array_sort(F.filter(F.split(text, ""), lambda c: c.rlike(r"^(?:[0-9A-Za-z]|[\p{L}\p{Nd}&&[^\x{0}-\x{2FF}]])$"))), "")


def counted(text: Column) -> Column:
    """The characters that bag() sorts, in the text's order."""
    return F.regexp_replace(text, r"[\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{2FF}[^\p{L}\p{Nd}\x{0}-\x{2FF}]]+", "")


def same_bag(a: Column, b: Column) -> Column:
    """bag(a) == bag(b) and neither is empty. Characters are sorted only where there are as many of them."""
    chars = lambda c: F.sort_array(F.split(c, ""))
    as_many = lambda v: (v["x"] != "") & (F.length(v["x"]) == F.length(v["y"]))
    return bind(F.struct(counted(a).alias("x"), counted(b).alias("y")), lambda v: F.when(as_many(v), chars(v["x"]) == chars(v["y"])).otherwise(False))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: higher-order functions share nothing of what their arguments have in common."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends; characters of scripts without spaces stand alone.

    Three passes over the whole text, none of them for each word: such characters are set apart by spaces (where there are any), then punctuation beside white space or an end is cut, and the rest is split.
    """
    low = F.lower(text)
    apart = F.when(low.rlike(f"[{UNSPACED}]"), F.regexp_replace(low, f"([{UNSPACED}])", " $1 ")).otherwise(low)
    # a mark goes if only marks are between it and white space or an end
    bare = F.regexp_replace(apart, r"(?U)(?<!\S)\p{P}++|(?<!\p{P})\p{P}++(?!\S)", " ")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda p: p != "")


def shingles(words: Column, k: int = SHINGLE_WORDS) -> Column:
    """Distinct runs of k words, joined; all words as one, if they are fewer; none without words."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        shifted = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(n - k + 1, F.lit(0))).alias(f"w{i}") for i in range(k)])
        each = F.array_distinct(F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(k)])))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(w, " "))).otherwise(each)

    return bind(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 without items."""

    def share(v: Column) -> Column:
        def of(both: Column) -> Column:
            union = F.size(v["a"]) + F.size(v["b"]) - both
            return F.when(union == 0, F.lit(0.0)).otherwise(both.cast("double") / union.cast("double"))

        return bind(F.size(F.array_intersect(v["a"], v["b"])), of)

    return F.when(a.isNotNull() & b.isNotNull(), bind(F.struct(a.alias("a"), b.alias("b")), share))


def text_similarity(words_a: Column, words_b: Column) -> Column:
    """Of two texts' words by their shingles; null where both have fewer than MIN_SHINGLES of them."""

    def of(v: Column) -> Column:
        return F.when((F.size(v["x"]) >= MIN_SHINGLES) | (F.size(v["y"]) >= MIN_SHINGLES), jaccard(v["x"], v["y"]))

    return bind(F.struct(shingles(words_a).alias("x"), shingles(words_b).alias("y")), of)


def without_digits(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(r"\p{Nd}"))


def likeness(words_a: Column, words_b: Column) -> Column:
    """Of two pages' words: by shingles where either has MIN_SHINGLES, else by words, leaving numbers out if both have others."""

    def short(v: Column) -> Column:
        def of(w: Column) -> Column:
            return F.when((F.size(w["x"]) > 0) & (F.size(w["y"]) > 0), jaccard(F.array_distinct(w["x"]), F.array_distinct(w["y"]))).otherwise(jaccard(F.array_distinct(v["x"]), F.array_distinct(v["y"])))

        return bind(F.struct(without_digits(v["x"]).alias("x"), without_digits(v["y"]).alias("y")), of)

    return bind(F.struct(words_a.alias("x"), words_b.alias("y")), lambda v: F.coalesce(text_similarity(v["x"], v["y"]), short(v)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, MINHASH_SLOTS + 1, dtype=np.uint64) * np.uint64(_STEP))


def shingle_hashes(words: list[str], k: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the runs of k words, repeats included."""
    k = max(k, 1)
    if not len(words):
        return np.zeros(0, np.uint64)
    w = np.array([xxhash.xxh64_intdigest(x.encode()) for x in words], np.uint64)
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(_STEP) ^ w[i : len(w) - k + 1 + i])
    return h


def minhash_of(hashes: np.ndarray) -> np.ndarray:
    """MINHASH_SLOTS minima; all ones for none."""
    out = np.full(MINHASH_SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        out = np.minimum(out, mix(hashes[i : i + 4096, None] ^ _SEEDS[None, :]).min(0))
    return out


@F.pandas_udf(StructType([StructField("distinct", IntegerType()), StructField("slots", ArrayType(LongType()))]))
def signature(words: pd.Series) -> pd.DataFrame:
    """Distinct shingles and MinHash of arrays of words."""
    rows = [shingle_hashes(list(w) if w is not None else []) for w in words]
    return pd.DataFrame({"distinct": [len(np.unique(h)) for h in rows], "slots": [minhash_of(np.unique(h)).view(np.int64).tolist() for h in rows]})


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(MINHASH_SLOTS))


def signature_similarity(a: Column, b: Column) -> Column:
    """Null where both have fewer than MIN_SHINGLES distinct shingles."""
    return F.when((a["distinct"] >= MIN_SHINGLES) | (b["distinct"] >= MIN_SHINGLES), minhash_similarity(a["slots"], b["slots"]))


@F.pandas_udf(LongType())
def simhash(words: pd.Series) -> pd.Series:
    """A bit for each column of the shingles' hashes with more ones than zeros; repeats vote again."""
    out = []
    for w in words:
        h = shingle_hashes(list(w) if w is not None else [])
        bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        votes = 2 * bits.sum(0).astype(np.int64) - len(h)
        out.append(int((np.uint64(1) << np.flatnonzero(votes > 0).astype(np.uint64)).sum(dtype=np.uint64).astype(np.int64)))
    return pd.Series(out, dtype="int64")


def simhash_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.cos(F.lit(np.pi) * F.bit_count(a.bitwiseXOR(b)) / 64))


def _letter(c: str, low: str = "A", high: str = "z") -> bool:
    return c.isascii() and c.isalpha()


def swapped_texts(a: str, b: str) -> bool:
    """Whether the texts differ by an exchange that the bag cannot see: of a separator between digits, or of an accented letter beside an ASCII letter.

    Positions are those without white space. Other differences may only be between characters that are not counted.
    """

    def stripped(t: str) -> list[tuple[str, bool]]:
        return [(c, i > 0 and _letter(t[i - 1]) or i + 1 < len(t) and _letter(t[i + 1])) for i, c in enumerate(t) if not c.isspace()]

    def between_digits(s: list[tuple[str, bool]], i: int) -> bool:
        return 0 < i < len(s) - 1 and s[i][0] in ",.:/-" and all(s[j][0] in "0123456789" for j in (i - 1, i + 1))

    x, y = stripped(a), stripped(b)
    exchange = False
    for i, ((c, c_near), (d, d_near)) in enumerate(zip(x, y, strict=True) if len(x) == len(y) else ()):
        if c == d:
            continue
        marks = between_digits(x, i) and between_digits(y, i)
        accents = all("\x80" <= z <= "˿" and z != "ï" and z.isalpha() for z in (c, d)) and (c_near or d_near)
        if marks or accents:
            exchange = True
        elif _COUNTED.match(c) or _COUNTED.match(d):
            return False
    return exchange


def same_text(a: str, b: str) -> bool:
    """Whether the texts are equal, or have the same characters in another order, none of them exchanged."""
    if a == b:
        return True
    x, y = ([c for c in t if _COUNTED.match(c)] for t in _narrowed(a, b))
    return bool(x) and sorted(x) == sorted(y) and not swapped_texts(a, b)


_NO_COUNTED_ASCII = bytes(i for i in range(256) if not (i < 128 and chr(i).isalnum()))


def _narrowed(a: str, b: str) -> tuple[str, str]:
    """Both texts; none, if their ASCII letters and digits are not the same, which is a quicker look."""
    x, y = (t.encode("utf-8", "surrogatepass").translate(None, _NO_COUNTED_ASCII) for t in (a, b))
    return (a, b) if len(x) == len(y) and sorted(x) == sorted(y) else ("", "")


class _Counted:
    @staticmethod
    def match(c: str) -> bool:
        return c.isascii() and c.isalnum() or c > "˿" and (c.isalpha() or unicodedata.category(c) == "Nd")


_COUNTED = _Counted()


@F.pandas_udf(BooleanType())
def swapped(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and swapped_texts(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(LongType())
def xxh64(content: pd.Series) -> pd.Series:
    """xxHash64 with seed 0, as a signed number."""
    return pd.Series([None if c is None else int(np.uint64(xxhash.xxh64_intdigest(c)).astype(np.int64)) for c in content], dtype="Int64")


def format_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%d B", n))
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", n / float(1024**i)))
    return out.otherwise(F.format_string("%.1f EB", n / float(1024**6)))
