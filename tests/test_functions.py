"""Golden cases of text, image, alignment and settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import image as I
from folio.functions import text as T
from folio.operators import align as A
from folio.operators import pages as P
from folio.options import Options

SWAPS = [
    ("due 1,500 USD", "due 1.500 USD", True), ("at 12:30", "at 12.30", True), ("Müller", "Möller", True), ("due 1,500 USD", "due 1,500 USD", False),
    ("due: 1500", "due; 1500", False), ("• item 1200", "ï item 1200", False), ("• a • b", "í a ñ b", False), ("in 2035. 3 City", "in 2035.3 City", False),
    ("• item", "¥ item", False), ("Total 2035. 3 rows, 7,5", "Total 2035.3 rows, 7, 5", False), ("items 1, 2 and 3.4", "items 1,2 and 3. 4", False), ("Þ item", "ß item", False),
    ("due 1,500 USD", "due 1. 500 USD", True), ("Amount due: 1,500 USD", "Amount due:1.500 USD", True), ("• Total 1,500 EUR", "¥ Total 1.500 EUR", True), ("• Total 1,500 EUR", "ï Total 1.500 EUR", True),
    ("• Total 1,500 EUR", "¥ Total 1.600 EUR", False), ("55-718 café EUR 75.227", "55-718caf å EUR 75.227", True), ("Müller AG", "M ö ller AG", True), ("55-718 café EUR", "55-718caf é EUR", False), ("Müller", "Möller x", False),
]


@pytest.mark.parametrize("a,b,want", SWAPS)
def test_swapped(a, b, want):
    assert T.swapped_texts(a, b) is want


def test_tokens(spark):
    rows = [("Invoice total: 1,250.00 EUR.\n\t-- Due  (now)",), ("pdf文件v2",), ("",), ("--",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.tokens(F.col("t"))).collect()]
    assert got == [["invoice", "total", "1,250.00", "eur", "due", "now"], ["pdf", "文", "件", "v2"], [], []]


def test_normalize_and_bag(spark):
    rows = [("café  x",), ("café x",), (" café x­ ",)]
    got = {r[0] for r in spark.createDataFrame(rows, "t string").select(T.normalize(F.col("t"))).collect()}
    assert got == {"café x"}
    assert spark.createDataFrame([("b1 é-Aж",)], "t string").select(T.bag(F.col("t"))).first()[0] == "1Abж"


@pytest.mark.parametrize("a,b,want", [("a b c", "a b c", 1), ("a b", "c d", 0), ("", "a", 0), ("a b", "b c", 1 / 3), ("a b page 1", "a b page 2", 1), ("total 1200", "total 1300", 1), ("1200", "1300", 0), ("1200", "1200", 1)])
def test_likeness(spark, a, b, want):
    assert A.text_likeness(A.words_of(a), A.words_of(b)) == pytest.approx(want)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.likeness(T.tokens(F.col("a")), T.tokens(F.col("b")))).first()
    assert row[0] == pytest.approx(want)


@pytest.mark.parametrize(
    "a,b,want",
    [
        ([1, 2, 3, 4], [1, 2, 9, 3, 4], [(0, 0), (1, 1), (2, 3), (3, 4)]),
        ([1, 2, 3, 4, 5], [1, 9, 2, 3, 8, 5], [(0, 0), (1, 2), (2, 3), (3, 4), (4, 5)]),
        ([1, 7, 8, 5], [1, 9, 5], [(0, 0), (1, 1), (3, 2)]),
        ([1, 2], [3, 4, 5], [(0, 0), (1, 1)]),
        ([None, 2], [None, 2, 3], [(0, 0), (1, 1)]),
    ],
)
def test_align(a, b, want):
    rows = A.align(a, b, lambda i, j: 0.0)
    assert sorted((i, j) for k, i, j in rows if k in ("exact", "gap")) == want
    assert sum(k == "deleted" for k, _, _ in rows) == len(a) - len(want) and sum(k == "inserted" for k, _, _ in rows) == len(b) - len(want)
    assert A.gap_pairs(101, 102, lambda i, j: 0.0) == [(i, i) for i in range(101)] and A.gap_pairs(4, 5, lambda i, j: float(j == i + 1)) == [(i, i + 1) for i in range(4)]


def test_hashes():
    flat, ramp = np.full((100, 100), 90, np.uint8), np.tile(np.arange(100, dtype=np.uint8), (100, 1))
    assert I.dhash(flat) == 0 and I.dhash(ramp) == (1 << 64) - 1
    half = np.zeros((64, 64), np.uint8)
    half[:, 32:] = 255
    assert I.ahash(half) == 0xF0F0F0F0F0F0F0F0
    s, pix = 1, []
    for _ in range(32 * 32):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        pix.append(s >> 24)
    img = np.array(pix, np.uint8).reshape(32, 32)
    assert bin(I.phash(img) ^ I.phash(255 - img)).count("1") == 64


def test_tiles_and_ink():
    page = np.full((900, 640), 180, np.uint8)
    mark = page.copy()
    mark[100:110, 100:110] = 0
    n, tile = I.ink_diff(page, mark)
    assert n == 100 and tile[2:] == (64, 90) and I.changed_pixels(page, mark) == 100
    d, tile = I.tile_diff(page, mark)
    assert d == 180 and tile == (10, 10, 64, 90)
    assert I.ink_diff(page, page)[0] == 0 and I.ink_diff(page, page[:-3]) is None and I.ink_diff(page, page[:-2])[0] == 0


def test_strategic(spark):
    got = {r[0]: r[1] for r in spark.range(1, 200).select("id", P.strategic_pages(F.col("id"))).collect()}
    assert len(got[100]) == 12 and all(v[0] == 0 and v[-1] == n - 1 and n // 2 in v and v == sorted(set(v)) for n, v in got.items())


def test_options():
    with pytest.raises(ValueError, match="mode.*dpi.*threshold"):
        Options(mode="x", dpi=1, threshold=float("nan"))


def test_cli(tmp_path):
    from folio.cli import main

    for name, text in (("a", "x\ny"), ("b", "x\ny"), ("c", "x")):
        (tmp_path / name).write_text(text)
    p = lambda n: str(tmp_path / n)
    assert [main(["quick", p("a"), p("b")]), main(["quick", p("a"), p("c")]), main(["quick", p("a"), p("none")]), main(["quick", p("a"), str(tmp_path)]), main(["version"])] == [0, 1, 2, 2, 0]


def test_watch(spark, tmp_path):
    from folio.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(b"one")
    (tmp_path / "in/b").write_bytes(b"two")
    seen = []
    watch(spark, str(tmp_path / "in"), b"one", lambda df, _: seen.extend(tuple(r)[1:] for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == [(3, False), (3, True)]
