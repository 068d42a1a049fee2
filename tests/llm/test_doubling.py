"""Prefix doubling over all positions, and the query's selected positions, against the plain rule."""

import random

import pytest

from folio.llm import doubling, spans


@pytest.mark.parametrize("length", [8, 13, 100])
def test_repeated_windows(spark, length):
    rng = random.Random(length)
    base = "".join(rng.choice("abé ") for _ in range(400))
    rows = [(i, rng.choice([base[rng.randrange(200) :], base, "ab" * 80, "".join(rng.choice("ab") for _ in range(300))])) for i in range(0, 24, 2)] + [(1, None), (3, ""), (5, "short"), (7, "x" * 150), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for at in range(len(b) - length + 1):
            if b[at : at + length] in seen:
                want.add((i, at))
            seen.add(b[at : at + length])
    assert {tuple(r) for r in doubling.repeated_windows(df, length).collect()} == want
    if length == 100:
        runs = spans.repeated(spans.plain(df).where("doc_id is not null"), spans.byte_units, 100, (32, 72, 100), True)
        assert {(r.doc_id, r.at + k) for r in runs.collect() for k in range(r.n)} == want


def test_empty(spark):
    assert doubling.repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_paths_and_sources(spark):
    """Runs that go on alike in document and source are one path; a document that does not hold the source's words keeps its own."""
    runs = [(5, 0, 3, 1, 10), (5, 3, 2, 1, 13), (5, 5, 1, 2, 15), (5, 6, 4, 1, 16), (5, 20, 1, 1, 15), (6, 0, 3, 1, 10)]
    got = spans.paths(spark.createDataFrame(runs, "doc_id long, at int, n int, src long, sat int"))
    assert sorted(tuple(r) for r in got.select("doc_id", "at", "n", "src", "sat").collect()) == [(5, 0, 5, 1, 10), (5, 5, 1, 2, 15), (5, 6, 4, 1, 16), (5, 20, 1, 1, 15), (6, 0, 3, 1, 10)]


@pytest.mark.parametrize("f", [spans.remove_bytes, spans.remove_words])
def test_repeated_ids_lose_only_what_repeats(spark, f):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60))
    shared, other = text(), text()
    rows = [(1, shared), (2, shared), (2, other), (2, other), (3, "x " + shared), (None, shared), (None, shared)]
    got = f(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    gone = sorted(((r.doc_id or 0, r.n_removed) for r in got))
    whole = len(shared) if f is spans.remove_bytes else 60
    assert gone[0] == gone[1] == (0, 0) and gone[2] == (1, 0) and gone[-1] == (3, whole)
    assert [n for i, n in gone if i == 2].count(whole) >= 1 and (2, 0) in gone
