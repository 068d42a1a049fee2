"""Codec, tokens, packing, mixing and classifier against their definitions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from folio.llm import bpe, flac, media, mixing, packing, quality, queries
from folio.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a\n b", "\n\n x\n\n\ny  ", "it's we're 'real don't", "x <|endoftext|> y", "!!<|endoftext|>!!  z", "日本語 テスト", "a\t\tb c\x1c\x1d d", "!" * 200, "a" * 500, "😀😀 é", "end\n ", "'re"]


def test_token_counts_of_every_prefix():
    code, rng = bpe.Coder(PATH), random.Random(1)
    alphabet = [*"ab '\n\t !1<|é日😀s", "<|endoftext|>", "'re", "  "]
    for t in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 20))) for _ in range(300)]:
        want = [len(code.library.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)]
        tab = code.text_table(t)
        assert bpe.prefix_counts(tab).tolist() == want, repr(t)
        assert np.frombuffer(code.text_ids(t), "<u4").tolist() == code.library.encode(t, add_special_tokens=False).ids
        for budget in (0, 1, 3):
            assert bpe.fits(tab, budget) == max([i for i, c in enumerate(want, 1) if c <= budget], default=0)


def test_op10(spark):
    library = bpe.Coder(PATH).library
    got = bpe.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string"), PATH, limit=5).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t in enumerate([*ODD, None])}


def test_flac_round_trip():
    rng = np.random.default_rng(0)
    data = [bytes(64), bytes(64 * 20), rng.bytes(64 * 33), bytes(range(256)) * 8, bytes([i // 40 % 256 for i in range(64 * 700)]), (np.sin(np.arange(64 * 90) / 9) * 90 + 128).astype(np.uint8).tobytes(), b"text of words " * 64]
    stored = flac.encode(data)
    assert flac.decode(stored) == data and flac.encode(data) == stored
    assert flac.read_samples(stored[4], 500, 2000) == data[4][500:2500] and flac.read_samples(stored[4], 10**9, 5) == b""
    for at in (-1, -9, 60):
        broken = bytearray(stored[5])
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_op1(spark):
    rows = [(1, "abc" * 300), (2, None), (3, ""), (None, "x" * 64), (1, "abc" * 300)]
    out = media.store(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in out.collect():
        p = media.padded(dict(rows)[r.doc_id].encode() if dict(rows)[r.doc_id] else b"")
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes, r.media_sha256) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p), hashlib.sha256(bytes(r.media)).hexdigest())
    blocks = media.pcm_blocks(out.where("doc_id = 1").limit(1)).orderBy("sample_offset").collect()
    assert sum(b.n_samples for b in blocks) == 960 and blocks[1].sample_offset == flac.BLOCK


def test_op6(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.scores(table(spark, d, "documents"), table(spark, d, "labels")).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) > 0.95 * len(got) > 30
    none = quality.scores(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(none) == 2 and none[0].score == none[1].score


def test_packing_plan():
    rng = random.Random(2)
    for size in (10, 100, 1024):
        counts: dict[int, int] = {}
        for _ in range(2000):
            x = min(size, int(rng.expovariate(3 / size)) + 1)
            counts[x] = counts.get(x, 0) + 1
        patterns = packing.plan(counts, size)
        back: dict[int, int] = {}
        for lengths, times in patterns:
            assert sum(lengths) <= size
            for x in lengths:
                back[x] = back.get(x, 0) + times
        assert back == counts
        least = -(-sum(k * v for k, v in counts.items()) // size)
        assert sum(t for _, t in patterns) <= least + max(2, least // 100)
    assert packing.plan({}, 10) == [] and sum(t for _, t in packing.plan({6: 2, 4: 2}, 10)) == 2


def test_op7(spark, sf_dir):
    rows = queries.op7_best_fit_packing(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    code, places = bpe.Coder(PATH), {}
    for r in rows:
        ids = np.array([*code.library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs_len = len(ids)
        assert (r.piece == 0) == (r.start == 0) and r.start + r.length <= docs_len
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024
    assert len(places) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_op8(spark, sf_dir):
    got = queries.op8_source_mixing(spark, sf_dir)
    cols = sorted(got.columns)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(c.execute(f"select {', '.join(cols)} from ({queries.SQL['op8_source_mixing']})").fetchall())
    rows = [(i, f"w {i} " * (i % 7), f"s{i % 3}" if i % 5 else None, 1) for i in range(60)] + [(99, None, "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    want = {s: t for s, t in ((r.source, r.t) for r in mixing.mix_report(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect())}
    mixed = mixing.mix(docs)
    words: dict = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert words == want and mixed.columns == docs.columns


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert set(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns) == set(docs.columns)
