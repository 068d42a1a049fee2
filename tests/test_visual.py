"""Pages by their rasters, content hashes, and texts whose bags are equal but whose marks were exchanged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import content, pages, visual
from folio.options import Options
from folio.plans import cascade


def page(edit=None):
    rng = np.random.default_rng(1)
    p = np.full((360, 256), 255, np.uint8)
    for y in range(40, 320, 12):
        p[y : y + 5, 20 : 20 + rng.integers(120, 210)] = 0
    if edit:
        edit(p)
    return p


def stamp(p):
    p[330:350, 200:240] = 0


@pytest.fixture(scope="module")
def rasters(spark):
    images = {1: page(), 2: page(), 3: page(stamp), 4: 255 - page(), 5: np.full((10, 10), 7, np.uint8)}
    rows = [(i, *p.shape, 1, bytearray(p.tobytes())) for i, p in images.items()]
    return spark.createDataFrame(rows, "id long, height int, width int, channels int, pixels binary")


def test_pages_by_raster(spark, rasters):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 5), (1, 5)], "a long, b long")
    got = {(r.a, r.b): r for r in visual.score_pages(rasters, pairs).collect()}
    assert got[1, 2].similarity == 1 and not got[1, 2].is_different
    assert got[1, 3].tile_changed and got[1, 3].is_different and got[1, 3].similarity > 0.85  # the hashes cannot see a stamp
    assert got[1, 4].is_different and got[1, 4].similarity < 0.5
    assert got[5, 5].tile_similarity is None and not got[5, 5].is_different  # smaller than the grid
    off = {(r.a, r.b): r for r in visual.score_pages(rasters, pairs, options=Options(tiles=False, hash_type="dhash")).collect()}
    assert not off[1, 3].tile_changed and off[1, 3].tile_similarity is None


def test_text_of_rasters(spark, rasters):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    texts = spark.createDataFrame([(1, 2, True, False, 0.4), (1, 3, True, False, 0.4)], "a long, b long, both_have_text boolean, same boolean, text_similarity double")
    got = {(r.a, r.b): r for r in visual.score_pages(rasters, pairs, texts).collect()}
    assert not got[1, 2].text_changed and got[1, 2].similarity >= 0.99  # nobody sees it
    assert got[1, 3].text_changed and got[1, 3].similarity == 0.4 and got[1, 3].tile_similarity is None


def test_no_rasters(spark, rasters):
    none = rasters.limit(0)
    assert visual.hashes(none).count() == visual.score_pages(none, spark.createDataFrame([(1, 2)], "a long, b long")).count() == 0


@pytest.mark.parametrize(
    "x,y,status",
    [
        ("Amount due: 1,500 USD", "Amount due: 1.500 USD", "DIFFERENT"),
        ("Müller und Sohn", "Möller und Sohn", "DIFFERENT"),
        ("one two three", "three two one", "SIMILAR"),
        ("one, two", "one two", "SIMILAR"),
        ("paid 10", "paid 11", "DIFFERENT"),
    ],
)
def test_exchanged_marks_are_no_same_text(spark, x, y, status):
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    row = cascade.compare(docs, spark.createDataFrame([(1, 2)], "a long, b long")).first()
    assert row.status == status and row.text_changed == (status == "DIFFERENT")


def test_content_hashes(spark):
    rows = [(1, 0, "text", "abc", True), (1, 1, "path", "x", True), (2, 1, "path", "x", True), (2, 0, "text", "abc", True), (3, 0, "path", "x", True), (3, 1, "text", "abc", True), (4, 0, "shading", "s", False), (5, 0, "text", None, True), (6, 0, "text", "abc", None)]
    objects = spark.createDataFrame(rows, "id long, ord int, kind string, content string, hashable boolean")
    h = {r.id: r.content for r in content.content_hashes(objects).collect()}
    assert h[1] == h[2] != h[3] and h[4] is None and h[5] is None and h[6] is None
    many = content.content_hashes(objects.withColumn("n", F.lit(150_000)), "n")
    assert {r.id: r.content is None for r in many.collect()} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True}
    told = spark.createDataFrame([(1, 9, 2, "h"), (2, 9, 2, "h"), (3, 9, 2, None), (4, 9, 3, "h"), (5, None, 2, "h")], "id long, text_hash long, objects int, content string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 3), (1, 4), (5, 5)], "a long, b long")
    assert {(r.a, r.b): r.skips for r in content.may_skip(pairs, told).collect()} == {(1, 2): True, (1, 3): False, (3, 3): False, (1, 4): False, (5, 5): False}


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for x, k in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    row = spark.range(1).select(
        content.geometry(F.lit(5), box(-5, 10, 700, 100.125), box(0, 0, 612, 792)).alias("box"),
        F.array(*[content.orientation(*map(F.lit, m)) for m in ((1.0, 0.0, 0.0, 1.0), (0.0, 1.0, -1.0, 0.0), (-1.0, 0.0, 0.0, -1.0), (0.0, -1.0, 1.0, 0.0), (1.0, 0.0, 0.0, -1.0))]).alias("turn"),
        F.array(content.quantised(F.lit(-0.125)), content.quantised(F.lit(1.0))).alias("q"),
    ).first()
    assert row.box == "1,0,1000,61200,10013" and list(row.turn) == [0, 1, 2, 3, 4] and list(row.q) == [-13, 100]


def test_consecutive_pairs_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE", 4)
    ids = [1, 2, 3, 9, 10, 30, 31, 70]
    docs = spark.createDataFrame([(i, "s") for i in ids] + [(i, None) for i in (4, 5, 50)] + [(None, "s")], "doc_id long, source string")
    got = sorted((r.a, r.b) for r in pages.consecutive_pairs(docs).collect())
    assert got == sorted([*zip(ids, ids[1:]), (4, 5), (5, 50)])


def test_estimates_are_near_the_exact_similarity(spark):
    """MinHash within four standard errors; SimHash orders texts by how much they share."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows, exact = [], {}
    for k, share in enumerate((1.0, 0.9, 0.7, 0.5, 0.2, 0.0)):
        n = int(400 * share)
        rows.append((k, base[:n] + [f"v{k}x{i}" for i in range(400 - n)]))
        grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        x, y = grams(base), grams(rows[-1][1])
        exact[k] = len(x & y) / len(x | y)
    df = spark.createDataFrame([(k, base, w) for k, w in rows], "k int, a array<string>, b array<string>")
    got = {}
    made = df.select("k", T.signature("a").alias("sa"), T.signature("b").alias("sb"), T.simhash("a").alias("ha"), T.simhash("b").alias("hb"))
    for r in made.select("k", T.signature_similarity(F.col("sa"), F.col("sb")).alias("m"), T.simhash_similarity(F.col("ha"), F.col("hb")).alias("s")).collect():
        got[r.k] = r
        assert abs(r.m - exact[r.k]) <= 4 * np.sqrt(exact[r.k] * (1 - exact[r.k]) / 128) + 1 / 128
    assert got[0].s == 1 and got[1].s > got[3].s > got[5].s


def test_text_similarity_needs_shingles(spark):
    long = [f"w{i}" for i in range(80)]
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "b", "d"]), (2, long, long), (3, long, ["a"])], "k int, a array<string>, b array<string>")
    assert {r.k: r.s for r in df.select("k", T.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()} == {1: None, 2: 1.0, 3: 0.0}
