"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage; and the pipeline's stages against plain versions."""

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from folio.llm import bpe, jaccard, lines, media, mixing, packing, quality, queries, spans, vectors
from folio.llm.common import SYMBOLS, Rolling, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use within.
NAMES = "_lines _gone _id _at _score_ _d _s _words _e _cut _last row key rep comp h h1 h2 run n spans rounds count size first src sat line pos class lead part role kind score"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES.split())
LONG = "\n".join(f"line {i} of a very long text with the number {i * 7919 % 10007}" for i in range(40_000))  # 2 MB


def odd(spark, rows):
    more = [7] * len(NAMES.split())
    return spark.createDataFrame([(i, t, "en", s, 5, *more) for i, t, s in rows], SCHEMA).repartition(3)


ROWS = [(1, "one common line of words\nand another one that differs", "a"), (1, "one common line of words\nand another one that differs", "a"), (2, None, None), (2, "", "a"), (None, "one common line of words", "a"), (None, None, None), (3, " \n\t ", "b"), (4, LONG, "b"), (5, LONG, "b"), (6, "one common line of words\nand another one that differs", "c"), (1, "some other text under an id that repeats", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (1, 0)], "doc_id long, quality int")


def operators(docs, labels):
    return {
        "media": media.store(docs),
        "bytes": spans.remove_bytes(docs),
        "join": jaccard.join(docs, 3, 90),
        "lines": lines.report(docs, least_words=1),
        "scores": quality.scores(docs, labels),
        "pieces": packing.pack_documents(docs, PATH),
        "mix": mixing.mix_report(docs),
        "words": spans.remove_words(docs),
        "tokens": bpe.token_counts(docs, PATH, keep_table=False),
    }


def test_operators_take_odd_tables(docs, labels):
    for name, out in operators(docs, labels).items():
        rows = out.collect()
        if name != "pieces":
            assert len(rows) == len(ROWS), name
        assert sorted({str(r.doc_id) for r in rows}) == sorted({str(i) for i, _, _ in ROWS}), name


def test_operators_take_empty_tables(docs, labels):
    none = docs.limit(0)
    for name, out in operators(none, labels.limit(0)).items():
        assert out.count() == 0, name
    assert vectors.near_duplicates(none.selectExpr("doc_id vec_id", "array(1f) embedding")).count() == 0
    for f in (lambda d: quality.keep_good(d, labels), lambda d: lines.dedup(d, least_words=1), jaccard.keep_first, mixing.mix):
        assert f(none).count() == 0 and f(none).columns == none.columns


def test_stages_keep_odd_columns(docs, labels):
    for f in (lambda d: quality.keep_good(d, labels, 0.0), lambda d: lines.dedup(d, least_words=1), jaccard.keep_first, mixing.mix):
        out = f(docs)
        assert out.columns == docs.columns and all(r["row"] == r["_gone"] == 7 for r in out.select("row", "_gone").collect())


def test_long_copies(docs):
    """The second of two equal texts of 2 MB loses all it has."""
    n = len(LONG.encode())
    assert {r.doc_id: r.n_removed for r in spans.remove_bytes(docs).collect() if r.n_bytes == n} == {4: 0, 5: n}
    words = len(LONG.split())
    assert {r.doc_id: r.n_removed for r in spans.remove_words(docs).collect() if r.n_words == words} == {4: 0, 5: words}
    kept = {r.doc_id for r in lines.dedup(docs, least_words=1).collect()}
    assert 5 not in kept and 6 not in kept
    assert [r.component_id for r in jaccard.join(docs, 3, 90).where("doc_id = 5").collect()] == [4]


def test_mix_meets_its_budget_with_repeated_rows(spark):
    rows = [(1, "a b c d e f g h i j k", "x")] * 5 + [(2, "m n o", "y"), (3, None, "y"), (4, "w " * 200, "z")]
    docs = odd(spark, rows)
    want = {r.source: r["sum(taken)"] for r in mixing.mix_report(docs).groupBy("source").sum("taken").collect()}
    got: dict = {}
    for r in mixing.mix(docs).collect():
        got[r.source] = got.get(r.source, 0) + len((r.text or "").split())
    assert got == want


def test_vectors_of_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [0.0, 1.0]), (4, [0.0, 0.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    assert got == sorted([(2, 2, 2), (3, 2, 2), (3, 2, 2), (4, 0, 4), (4, 0, 4)], key=repr)


def test_features_and_seeking(spark):
    """The feature of a payload by its definition, and blocks of a null medium."""
    import hashlib

    text = "Some text, é."
    r = media.store(odd(spark, [(1, text, "a")])).first()
    p = text.encode() + bytes(64 - len(text.encode()) % 64)
    s = [b - 128 for b in p]
    crossings = sum((x < 0) != (y < 0) for x, y in zip(s, s[1:])) / (len(s) - 1)
    assert r.feature == f"mean={np.mean(s):.4f};rms={np.sqrt(np.mean(np.square(s))):.4f};peak={max(map(abs, s))};zcr={crossings:.4f}"
    assert r.payload_sha256 == hashlib.sha256(p).hexdigest()
    assert media.pcm_blocks(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def test_names_have_the_bits_of_both_hashes():
    """Runs are named by other symbols than anchors."""
    u = spans.byte_units(b"some bytes of a window " * 9)
    h = Rolling(u).windows(100)
    run = spans.run_names(u, np.arange(len(h)), np.ones(len(h), int), 100)
    assert not np.intersect1d(h, run).size and (SYMBOLS[1] != 0)


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Each stage on all rows of the one before, against plain versions; the classifier against its own scores."""
    docs = table(spark, sf_dir, "documents")
    good = corpus_pipeline.quality_classifier(spark, docs, sf_dir).cache()
    accepted = {r.doc_id for r in queries.op6_quality_classifier(spark, sf_dir).collect() if r.score >= 0.7}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {i for i, _ in rows} == accepted and good.columns == docs.columns
    deduped = corpus_pipeline.line_dedup(spark, good, sf_dir).cache()
    want = {i: t for i, t in brute.line_dedup(rows, least_words=1).items() if t is not None}
    rows = [(r.doc_id, r.text) for r in deduped.collect()]
    assert dict(rows) == want
    first = corpus_pipeline.jaccard_join(spark, deduped, sf_dir).cache()
    comp = brute.op3(rows, 5, 80)
    assert {r.doc_id: r.text for r in first.collect()} == {i: t for i, t in rows if comp[i][1] == i}
    mixed = corpus_pipeline.source_mix(spark, first, sf_dir).cache()
    target = {r.source: (r.target, r.source_size) for r in mixing.mix_report(first).collect()}
    took: dict = {}
    for r in mixed.collect():
        took[r.source] = took.get(r.source, 0) + len(r.text.split())
    assert all(abs(took.get(s, 0) - t) <= 0.5 for s, (t, _) in target.items()) and all(t <= 3 * n for t, n in target.values())
    library = bpe.Coder(PATH).library
    want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    pieces = corpus_pipeline.best_fit_packing(spark, mixed, sf_dir).collect()
    assert sum(p.length for p in pieces) == sum(n for _, n in want) and {p.doc_id for p in pieces} == {i for i, _ in want}
    places: dict = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024
    for df in (good, deduped, first, mixed):
        df.unpersist()


def test_every_sql_of_the_subpackage(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        cols = sorted(got.columns)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(c.execute(f"select {', '.join(cols)} from ({sql})").fetchall()), name
