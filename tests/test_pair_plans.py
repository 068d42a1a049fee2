"""Whole documents side by side: the same decisions as page by page, without work that no column asks for."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folio import queries
from folio.functions import text as T
from folio.operators import align as A
from folio.options import Options
from folio.plans import cascade

ODD = ["", " ", "...", "a1", "1a", "a1 b", "b a1", "1,500", "1.500", "1.500 x", "x 1,500", "Ünder", "Önder", "ab é", "ab è", "été", "日本 語", "語 日本", "日本", "Ωa", "aΩ", "𝔘1", "1𝔘", "٣ ab", "ab ٣", "x­1", "1x"]
PAGES = ["a page of text", "page a of text", "in all 1,500 paid", "in all 1.500 paid", "another one", "日本 語", "語 日本", "--", "=="]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(5)
    docs = [(i, "\n".join(r.choice([*PAGES, "", "  "]) for _ in range(r.choice([0, 1, 1, 2, 2, 3, 6, 9])))) for i in range(60)] + [(60, None), (61, docs_of(12, 1)), (62, docs_of(12, 2))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(63), 2) if (a + b) % 3 == 0], "a long, b long")
    return dict(docs), table, pairs


def docs_of(n, last):
    return "\n".join([f"page {i}" for i in range(n)] + [f"the end, {last}"])


def same(x, y):
    return x == y or bool(counted(x)) and sorted(counted(x)) == sorted(counted(y)) and not T.swapped_texts(x, y)


def counted(t):
    return [c for c in t if T._COUNTED.match(c)]


def pages(t):
    return [p for p in (t or "").split("\n") if p.strip(" ")]


def test_equal_bags_of_odd_texts(spark):
    rows = spark.createDataFrame(list(itertools.product(ODD, ODD)), "x string, y string")
    got = rows.select("x", "y", T.same_bag(F.col("x"), F.col("y")).alias("g"), ((T.bag(F.col("x")) == T.bag(F.col("y"))) & (T.bag(F.col("x")) != "")).alias("w"))
    assert [tuple(r) for r in got.where("g <> w").collect()] == []
    assert [(x, y) for x, y in itertools.product(ODD, ODD) if T.same_text(x, y) != same(x, y)] == []


def test_likeness_against_plain_sets():
    """tables of few and of many cells, of long and of short pages, are those of plain sets."""
    r = random.Random(3)

    def page(n):
        return " ".join(r.choice(["word", "words,", "12", "1b", "日本語", "(end)", "--", *(f"w{i}" for i in range(30))]) for _ in range(n))

    def share(x, y):
        return len(x & y) / len(x | y) if x | y else 0.0

    def plain(a, b):
        x, y = A.words_of(a), A.words_of(b)
        runs = [{tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set() for w in (x, y)]
        if max(map(len, runs)) >= T.MIN_SHINGLES:
            return share(*runs)
        words = [{z for z in w if not any(c.isdecimal() for c in z)} for w in (x, y)]
        return share(*(words if all(words) else (set(x), set(y))))

    for n, m in ((2, 3), (20, 30), (30, 7)):
        a, b = ([page(r.choice([0, 1, 2, 5, 20, 90])) for _ in range(k)] for k in (n, m))
        got = A.likeness_table([A.words_of(t) for t in a], [A.words_of(t) for t in b])
        assert got.tolist() == [[plain(s, t) for t in b] for s in a]


def test_aligned_pairs_travel_as_whole_documents(spark, sf_dir, planted):
    """what compare() says of pairs with other page counts is what align() says of their pages; no page travels alone to be grouped again."""
    docs, table, pairs = planted
    got = {(r.a, r.b): (r.text_changed, r.different_pages, r.deleted, r.inserted) for r in cascade.compare(table, pairs).where("strategy like '%aligned'").collect()}
    assert len(got) > 100
    for (a, b), found in got.items():
        x, y = pages(docs[a]), pages(docs[b])
        rows = A.align(x, y, A_like(x, y))
        other = sorted(i + 1 for k, i, j in rows if k in ("exact", "gap") and not same(x[i], y[j]))
        assert found == (bool(other), other, sorted(i + 1 for k, i, _ in rows if k == "deleted"), sorted(j + 1 for k, _, j in rows if k == "inserted"))
    assert "FlatMapGroupsInPandas" not in plan(queries.QUERIES["result_json"](spark, sf_dir))


def test_ids_that_repeat_keep_their_strategies_apart(spark):
    """of two copies of an id with other page counts each combination has the result of its own strategy."""
    table = spark.createDataFrame([(1, "one\ntwo"), (1, "one\ntwo\nthree"), (2, "two\none"), (2, "x\ntwo\none")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    statuses = [sorted(r.status for r in f(table, pairs).collect()) for f in (cascade.compare, cascade.verdicts)]
    assert statuses[0] == statuses[1] and len(statuses[0]) == 16


def A_like(x, y):
    return lambda i, j: A.text_likeness(A.words_of(x[i]), A.words_of(y[j]))


@pytest.mark.parametrize("options", [Options(), Options(sampling="all"), Options(mode="byte"), Options(text_change="scored"), Options(sampling="thumbnail")], ids=str)
def test_verdicts_are_those_of_the_whole_comparison(planted, options):
    """the status alone, without alignment and likeness, is the status of compare()."""
    _, table, pairs = planted
    rows = [sorted(tuple(r) for r in f(table, pairs, options).select("a", "b", "status").collect()) for f in (cascade.verdicts, cascade.compare)]
    assert rows[0] == rows[1] and len(rows[0]) == pairs.count()


@pytest.mark.parametrize("name", ["verdict_similar", "verdict_status", "text_changed_pairs"])
def test_verdicts_need_no_alignment(spark, sf_dir, name):
    p = plan(queries.QUERIES[name](spark, sf_dir))
    assert not any(x in p for x in ("FlatMapGroupsInPandas", "MapInArrow", "array_intersect"))


def test_changes_are_those_of_all_pages(planted):
    """pairs whose pages are compared at their places, as compare() of all pages has them."""
    _, table, pairs = planted
    got = sorted(tuple(r) for r in cascade.changes(table, cascade.staged(table, pairs)).select("a", "b", "changed", "n_different").collect())
    want = cascade.compare(table, pairs, Options(sampling="all")).where("strategy = 'all'").select("a", "b", "text_changed", F.size("different_pages"))
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 50
