"""The operators' rows against plain versions, over a whole small table and over planted cases."""

import random

import brute
import numpy as np
import pytest

from folio.llm import jaccard, lines, spans, vectors
from folio.llm.common import table


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    base = [" ".join(word() for _ in range(rng.randrange(30, 120))) for _ in range(12)]
    docs = list(base)
    for b in base:
        docs.append(b)
        for n in (1, 2, 6):
            w = b.split()
            for _ in range(n):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    for _ in range(8):
        docs.append(" ".join(word() for _ in range(rng.randrange(0, 40))) + " " + passage + " " + " ".join(word() for _ in range(rng.randrange(0, 40))))
    docs += ["a" * 400, "ab" * 300, "x y " * 200, "", " ", None, "one", "one two", "One  TWO", "\n\n", passage, passage[:100], passage[:99], passage[3:103]]
    docs += [f"the same line of words {i}\nanother line that is quite different {word()}\nand one common line of words here" for i in range(12)]
    docs += ["long " + " ".join(word() for _ in range(3000)), "一 二 三 " * 60]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i * 7 + 1, docs[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    real = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    return {"real": [tuple(r) for r in real], "planted": planted()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, h long").repartition(3)


@pytest.mark.parametrize("name", ["real", "planted"])
def test_op2(spark, tables, name):
    got = {r[0]: tuple(r)[1:] for r in spans.remove_bytes(frame(spark, tables[name])).collect()}
    assert got == brute.op2(tables[name])


@pytest.mark.parametrize("name", ["real", "planted"])
def test_op9(spark, tables, name):
    got = {r[0]: tuple(r)[1:] for r in spans.remove_words(frame(spark, tables[name])).collect()}
    assert got == brute.op9(tables[name])


def test_parts_of_long_documents(spark, tables, monkeypatch):
    monkeypatch.setattr(spans, "PART", 64)
    for units, length, k in ((spans.byte_units, 20, 6), (spans.byte_units, 20, 20)):
        u = units(b"abcabd" * 60)
        h, run, at, n = spans.anchors(u, length, k)
        assert n.sum() == len(u) - length + 1 and (at[1:] == at[:-1] + n[:-1]).all()


@pytest.mark.parametrize("name,words,percent", [("real", 3, 90), ("planted", 3, 90), ("planted", 5, 80)])
def test_op3(spark, tables, name, words, percent):
    got = {r[0]: tuple(r)[1:] for r in jaccard.join(frame(spark, tables[name]), words, percent).collect()}
    assert got == brute.op3(tables[name], words, percent)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_op3_pairs_at_the_threshold_share_a_key(percent):
    """Sets of all small sizes that differ in as much as a pair may: none is missed."""
    rng = np.random.default_rng(percent)
    missed = 0
    for n in [*range(1, 30), 60, 200]:
        for m in range(n, 100 * n // percent + 1):
            common = -(-percent * (n + m) // (100 + percent))
            if common > n:
                continue
            for _ in range(3000 if n + m < 12 else 20):
                x = rng.integers(0, 1 << 63, n + m - common, dtype=np.int64).view(np.uint64) * np.uint64(2)
                a, b = np.sort(x[:n]), np.sort(x[n - common :])
                missed += not np.intersect1d(jaccard.slice_keys(a, percent), jaccard.slice_keys(b, percent)).size
    assert missed == 0


def test_op3_cuts_hot_groups_into_leaves(spark, tables, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    got = {r[0]: tuple(r)[1:] for r in jaccard.join(frame(spark, tables["planted"]), 3, 90).collect()}
    assert got == brute.op3(tables["planted"])


@pytest.mark.parametrize("name", ["real", "planted"])
def test_op4(spark, tables, name):
    want = brute.line_dedup(tables[name])
    got = {r[0]: r[1] for r in lines.dedup(frame(spark, tables[name])).select("doc_id", "text").collect()}
    assert got == {i: t for i, t in want.items() if t is not None or dict(tables[name])[i] is None}
    report = {r[0]: tuple(r)[1:] for r in lines.report(frame(spark, tables[name])).collect()}
    for i, t in tables[name]:
        n = 0 if t is None else len(t.split("\n"))
        kept = 0 if want[i] is None else len(want[i].split("\n"))
        assert report[i] == (n, n - kept, brute.sha((want[i] or "").encode())), (i, t)


def test_op4_refines_keys_of_many_lines(spark, monkeypatch):
    """Lines of one length that share all but a small part, in many components."""
    monkeypatch.setattr(lines, "FEW", 2)
    rng = random.Random(9)
    rows = []
    for i in range(150):
        mark = "".join(rng.choice("abcd") for _ in range(rng.choice([3, 6, 6, 6, 7])))
        rows.append((i, rng.choice(["{} one two three four five six", "one two three {} four five six", "one two three four five six {}"]).format(mark)))
    rows += [(200 + i, "seven eight nine ten eleven twelve " + c) for i, c in enumerate(["a", "b", "ab", "bcd", "xy", "", "é"])]
    want = brute.line_dedup(rows)
    got = {r[0]: r[1] for r in lines.dedup(frame(spark, rows)).select("doc_id", "text").collect()}
    assert got == {i: t for i, t in want.items() if t is not None}


@pytest.mark.parametrize("most", [1, 2])
def test_op4_lines_of_any_length(spark, most):
    """With one word as the least: exact and near copies of short lines, of long words, and of lines in scripts without spaces."""
    rng = random.Random(12)
    few = ["Home", "Menu", "home", "}", "{", "a", "b", "ab", "bc", "cd", "é", "一", "一二", "Terms of use", "Terms of use.", "https://example.org/" + "a" * 90, "https://example.org/" + "a" * 89 + "b", "一二三四五六七八九十" * 3, "一二三四五六七八九十" * 2 + "一二三四五六七八九", " ", "", "\t", "\u00a0"]
    rows = [(i, "\n".join(rng.choice(few) for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    rows += [(100 + i, "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    want = brute.line_dedup(rows, most, least_words=1)
    got = {r[0]: r[1] for r in lines.dedup(frame(spark, rows), most, least_words=1).select("doc_id", "text").collect()}
    assert got == {i: t for i, t in want.items() if t is not None}


def test_op4_query_takes_every_line(spark, tables, sf_dir):
    from folio.llm import queries

    want = brute.line_dedup(tables["real"], least_words=1)
    got = {r.doc_id: r.kept_sha256 for r in queries.op4_line_dedup(spark, sf_dir).collect()}
    assert got == {i: brute.sha((want[i] or "").encode()) for i, _ in tables["real"]}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_edit_distance(spark, most):
    from pyspark.sql import functions as F

    rng = random.Random(most)
    pairs = []
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 14))]
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "b", "é"])
        pairs.append(("".join(a), "".join(b)))
    for _ in range(200):  # long middles: edits far apart, and texts that differ late
        a = [rng.choice("abcé") for _ in range(rng.randrange(20, 90))]
        b = list(a)
        for _ in range(rng.randrange(0, most + 2)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "\U0001f600"])
        pairs.append(("".join(a), "".join(b)))
    pairs += [("", ""), ("a", ""), ("", "a"), ("abab", "ababab"), ("aaaa", "aaa"), ("x" * 300, "x" * 301)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within_edits(F.col("a"), F.col("b"), most)).collect()
    assert [r[2] for r in got] == [brute.edits(r[0], r[1]) <= most for r in got]


def test_line_keys_meet(spark):
    """Lines within the edits share a key, one of them as index."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    for most in (1, 2):
        pairs = []
        for _ in range(200):
            a = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6, 40)))
            b = list(a)
            for _ in range(most):
                at = rng.randrange(0, len(b) + 1)
                b[at : at + rng.randrange(0, 2)] = rng.choice(["", "x"])
            pairs.append((a, "".join(b)))
        kinds = [s.index for s in lines.slots_of(F.lit(""), F.lit(0), most)]
        both = [F.array(*[s.key for s in lines.slots_of(F.col(c), F.char_length(c), most)]) for c in "ab"]
        for a, b, one, two in spark.createDataFrame(pairs, "a string, b string").select("a", "b", *both).collect():
            index = [{k for k, i in zip(x, kinds, strict=True) if i and k is not None} for x in (one, two)]
            assert index[0] & set(two) or index[1] & set(one), (a, b)


def test_op5(spark, sf_dir):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:180] = x[0] + rng.normal(size=(80, 16)) * 0.25
    x[180:200] = x[5] * 3
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()}
    f = np.float32(x).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    near = f @ f.T >= 0.9
    np.fill_diagonal(near, False)
    comp = brute.least_linked(range(300), [(a, b) for a, b in zip(*np.nonzero(near))])
    assert {i: got[i][:2] for i in range(300)} == {i: (int(near[i].sum()), comp[i]) for i in range(300)}
    assert got[1004][:2] == (1, 1004) and got[1005][:2] == (1, 1004) and not got[1005][2]
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1006)) and None not in got


def test_op5_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "STRIP", 7)
    monkeypatch.setattr(vectors, "CELL", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 32))
    x = np.repeat(x, 15, 0) + rng.normal(size=(300, 32)) * 0.08
    got = {r[0]: r[1] for r in vectors.near_duplicates(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum(1) - 1
    assert [got[i] for i in range(300)] == near.tolist()


@pytest.mark.parametrize("least", [0.9, 0.5])
def test_op5_pairs_across_many_cells(spark, monkeypatch, least):
    """Pairs at the very threshold among vectors without clusters, beside tight ones, with far more cells than any point is near."""
    monkeypatch.setattr(vectors, "CELL", 8)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(240, 24))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = least + 1e-4
    tight = np.repeat(rng.normal(size=(8, 24)), 20, 0) + rng.normal(size=(160, 24)) * 0.02
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y, tight])
    got = {r[0]: tuple(r)[1:3] for r in vectors.near_duplicates(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), least).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    comp = brute.least_linked(range(len(x)), list(zip(*np.nonzero(near))))
    assert got == {i: (int(near[i].sum()), comp[i]) for i in range(len(x))}


def test_op5_copies(spark):
    """Copies count as links of each other and of what any of them links to."""
    x = {7: [1.0, 0.0], 3: [1.0, 0.0], 9: [1.0, 0.0], 4: [1.0, 0.1], 5: [0.0, 1.0], 6: [0.0, 1.0], 8: [-1.0, 0.2]}
    got = {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")).collect()}
    assert got == {3: (3, 3, True), 7: (3, 3, False), 9: (3, 3, False), 4: (3, 3, False), 5: (1, 5, True), 6: (1, 5, False), 8: (0, 8, True)}


def test_merge():
    rng = np.random.default_rng(6)
    for n, m in ((50, 20), (50, 200), (200, 150)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        label = np.arange(n)
        for at in range(0, m, 30):
            vectors.merge(label, a[at : at + 30], b[at : at + 30])
        comp = brute.least_linked(range(n), list(zip(a.tolist(), b.tolist())))
        assert label.tolist() == [comp[i] for i in range(n)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert spans.remove_bytes(none).count() == spans.remove_words(none).count() == jaccard.join(none).count() == lines.dedup(none).count() == lines.report(none).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
