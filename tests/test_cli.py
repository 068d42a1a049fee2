"""The command line, sampling, and small operators of the harness."""

import json

import pytest

from folio import cli
from folio.operators import pages, report
from folio.options import Options
from folio.plans import cascade
from folio.sources import files


@pytest.fixture
def pair(tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("one page\nand another\nthe last\n")
    b.write_text("one page\nand some other\nthe last\n")
    return str(a), str(b)


def test_compare_prints_a_summary(spark, pair, capsys):
    assert cli.main(["-q", "compare", *pair, "--sampling", "all", "--dpi", "72", "-w", "2", "--timeout", "600"]) == 1
    said = capsys.readouterr().out
    assert "Status: DIFFERENT" in said and "Modified pages: [2]" in said and "3 pages, 30 B" in said
    assert cli.main(["-f", "json", "compare", pair[0], pair[0]]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "IDENTICAL"


def test_wrong_settings_and_files(spark, pair, capsys):
    assert cli.main(["compare", *pair, "--hash", "md5", "--dpi", "5"]) == 2
    said = capsys.readouterr().err
    assert "hash_type" in said and "dpi" in said
    assert cli.main(["compare", *pair, "--timeout", "-1"]) == 2
    assert cli.main(["quick", pair[0], pair[0] + "x"]) == 2
    assert cli.main(["quick", *pair]) == 1 and cli.main(["quick", pair[0], pair[0]]) == 0


def test_equal_contents(pair, tmp_path):
    copy = tmp_path / "c.txt"
    copy.write_bytes(open(pair[0], "rb").read())
    assert files.equal_contents(pair[0], str(copy), chunk=4) and not files.equal_contents(*pair) and files.same_file(pair[0], pair[0])


def test_sampling(spark):
    """A sample without a change is followed by all pages; one with a change is enough."""
    base = [f"page number {i} has some words of its own" for i in range(40)]
    change = lambda i: "\n".join([*base[:i], "quite another text", *base[i + 1 :]])
    n = spark.range(1).select(pages.strategic_pages(pages.F.lit(40)).alias("s")).first().s
    out = next(i for i in range(40) if i not in n)
    docs = spark.createDataFrame([(1, "\n".join(base)), (2, change(0)), (3, change(out)), (4, "\n".join(base) + "\n")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    told = {s: {r.b: (r.status, list(r.different_pages)) for r in cascade.compare(docs, pairs, Options(sampling=s)).collect()} for s in ("auto", "all", "strategic", "thumbnail")}
    assert told["auto"] == told["all"] == {2: ("DIFFERENT", [1]), 3: ("DIFFERENT", [out + 1]), 4: ("SIMILAR", [])}
    assert told["strategic"][3] == told["thumbnail"][3] == ("SIMILAR", []) and told["thumbnail"][2] == ("DIFFERENT", [1])


def test_pairing_and_errors(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", "broken"), (3, "c", None)], "page int, value string, err string")
    right = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "z", None)], "page int, value string, err string")
    got = {r.page: (r.x, r.y, r.err) for r in pages.paired(left, right, "page").collect()}
    assert got == {1: ("a", "x", None), 2: (None, None, "broken"), 3: (None, None, "page is missing on one side"), 4: (None, None, "page is missing on one side")}
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), ("c", 5, "z")], "doc string, page int, err string")
    assert {r.doc: r.message for r in report.joined_errors(rows, "doc").collect()} == {"a": "2 pages failed: page 1: y; page 2: x", "b": None, "c": "page 5: z"}
    size = spark.createDataFrame([(1, 10, 20), (1, 30, 5)], "pair int, width int, height int")
    assert pages.largest_page(size, "pair").first().bytes == 800
