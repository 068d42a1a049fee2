"""The queries of this subpackage, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folio.llm import bpe, jaccard, lines, media, mixing, packing, quality, spans, vectors
from folio.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(table(spark, sf_dir, "documents"), keep_media=False)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_bytes(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), 3, 90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"), least_words=1)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_words(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer(), keep_table=False).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_flac_media, op2_suffix_array_dedup, op3_ngram_jaccard_join, op4_line_dedup, op5_embedding_near_dedup, op6_quality_classifier, op7_best_fit_packing, op8_source_mixing, op9_debruijn_dedup, op10_token_counts, pipeline)}

_MIX = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '') || '/mix') as k
  from documents),
p as (select source, cast(sum(size) as bigint) as source_size from d group by source),
q as (select source, source_size, cast(3 * source_size as bigint) as cap,
             [5, 2, 1][cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as bigint)] as w from p),
r as (select *, cast(sum(source_size) over () as bigint) - coalesce(cast(sum(cap) over b as bigint), 0) as rest,
             cast(sum(w) over () as bigint) - coalesce(cast(sum(w) over b as bigint), 0) as rest_w,
             cast(cap as double) / cast(w as double) as ratio
      from q window b as (order by cast(cap as double) / cast(w as double), source asc nulls last rows between unbounded preceding and 1 preceding)),
s as (select *, cast(rest as double) / cast(rest_w as double) as unit from r),
u as (select unit from s where ratio >= unit order by ratio, source asc nulls last limit 1),
t as (select s.source, s.source_size, least(cast(s.cap as double), cast(s.w as double) * u.unit) as target from s, u),
e as (select d.*, t.source_size, t.target, cast(round(t.target) as bigint) as budget,
             cast(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls last, d.size rows between unbounded preceding and current row) as bigint) as upto
      from d join t on d.source is not distinct from t.source),
f as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from e)
select doc_id, size, source_size, target,
       cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - (upto - size))) as bigint) as taken
from f
"""

_JACCARD = r"""
with w as materialized (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
g as materialized (
  select doc_id, list_distinct(case when text_n = 0 then [] when text_n < 3 then [array_to_string(t, ' ')]
    else list_transform(range(1, text_n - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) end) as s
  from (select *, coalesce(len(t), 0) as text_n from w)),
x as materialized (select doc_id, unnest(s) as z from g),
i as materialized (
  select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.z = b.z and a.doc_id < b.doc_id group by 1, 2),
l as materialized (
  select a, b from i join g p on p.doc_id = a join g q on q.doc_id = b where 100 * c >= 90 * (len(p.s) + len(q.s) - c)),
e as materialized (select a, b from l union select b, a from l),
reach as (
  with recursive r(id, node) as (
    select doc_id, doc_id from documents
    union select r.id, e.b from r join e on e.a = r.node)
  select id, min(node) as component_id from r group by id)
select g.doc_id, cast(len(g.s) as bigint) as n_shingles, cast(reach.component_id as bigint) as component_id from g join reach on reach.id = g.doc_id
"""

SQL: dict[str, str] = {"op8_source_mixing": _MIX, "op3_ngram_jaccard_join": _JACCARD}
