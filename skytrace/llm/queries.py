"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, jaccard, kmtree, licenses, maxscore, mixing, ppm, prefixes, repair, simhash, suffixes, tokens
from .common import materialize, table

#: Place of the public tokenizer files; a parameter, as the files are no part of the repository.
TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))


def op1_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.tree_search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", digest=True)


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix(materialize(docs, "op7-docs"), weights=(1, 2, 3), cap=3.0, total=1.0, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.maxscore_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024.0)


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_nodes(prefixes.with_heads(prefixes.turn_lists(table(spark, sf_dir, "conversations"))))


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tree_search": op1_tree_search,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_ppm_scores": op4_ppm_scores,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_maxscore": op8_maxscore,
    "op9_co_training": op9_co_training,
    "op10_jaccard_components": op10_jaccard_components,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash_components": op12_simhash_components,
    "op13_structure_repair": op13_structure_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op8_maxscore": """
with good as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from good q join good c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 10
""",
    "op11_prefix_trie": r"""
with
ids as (select distinct conv_id as c from conversations where conv_id is not null),
turns as (
  select conv_id as c, t, length(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w, m,
         row_number() over (partition by conv_id order by turn nulls first, m) as k
  from (select conv_id, turn, coalesce(text, '') as t,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as m
        from conversations where conv_id is not null)
),
heads as (
  select c, c - c % 20 as base,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
             lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 as h
  from ids
),
rebuilt as (
  select c, m, w, row_number() over (partition by c order by part, k) as d
  from (select h.c, 1 as part, t.k, t.m, t.w from heads h join turns t on t.c = h.base and t.k <= h.h
        union all
        select h.c, 2, t.k, t.m, t.w from heads h join turns t on t.c = h.c and t.k > h.h)
),
paths as (
  select c, d, string_agg(m, '') over (partition by c order by d) as path, w from rebuilt
  union all
  select c, 0, '', 0 from ids
),
lengths as (select c, max(d) as n from paths group by c),
members as (
  select d, path, min(c) as conv_id, count(*) as n, any_value(w) as w,
         string_agg(c::varchar, ',' order by c) filter (d = l.n) as ends
  from paths join lengths l using (c) group by d, path
),
kids as (select p.d, p.path, count(*) as n_children from members p join members x on x.d = p.d + 1 and left(x.path, 32 * p.d) = p.path group by all),
below as (
  select v.d, v.path, sum((x.n - 1) * x.w) as saved, count(*) filter (k.n_children is null) as leaves
  from members v join members x on x.d >= v.d and left(x.path, 32 * v.d) = v.path
  left join kids k on k.d = x.d and k.path = x.path
  group by v.d, v.path
)
select v.conv_id, v.d as depth, p.conv_id as parent_conv_id, v.n as n_convs, coalesce(k.n_children, 0) as n_children,
       b.leaves as n_leaves, b.saved::bigint as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from members v
join below b on b.d = v.d and b.path = v.path
left join members p on p.d = v.d - 1 and p.path = left(v.path, greatest(32 * (v.d - 1), 0))
left join kids k on k.d = v.d and k.path = v.path
""",
    "op13_structure_repair": r"""
with recursive
crc as (
  select distinct coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as s from conversations
),
kinds as (
  select s, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(s, ''), lambda x: ascii(x)::bigint)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 as kind
  from crc
),
rows_ as (
  select conv_id, turn, copy, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
         case kind when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text
  from conversations join kinds on s = coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '),
       unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as x(copy)
),
seen as (
  select *, md5(length(role) || ':' || role || text) as m, left(role, 1) as i,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as e
  from rows_
),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, m, copy) as k,
         row_number() over (partition by conv_id, m order by turn nulls first, copy) > 1 as again
  from seen
),
faults as (
  select *, case when e = '' then 'b' when again then 'd' when e not in ('.', '!', '?') then 't' else 'k' end as f,
         lag(i) over (partition by conv_id order by k) as before
  from ordered
),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'b') as blank,
         count(*) filter (f = 'd') as duplicate, count(*) filter (f = 't') as truncated,
         count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, max(k) as n
  from faults group by conv_id
),
-- for each state the cheapest way to the end: ten digits of cost, then the audit, and the repaired turns.
-- 0: nothing yet, 1: after s, 2: after u, 3: after a
plain(conv_id, k, v0, v1, v2, v3) as (
  select conv_id, n + 1, {k: '0000000000', o: []::varchar[]}, {k: '0000000010II', o: ['user:', 'assistant:']}, {k: '0000000005I', o: ['assistant:']}, {k: '0000000000', o: []::varchar[]}
  from counts
  union all
  select conv_id, k,
    list_sort([b0, {k: lpad((left(b2.k, 10)::int + 5)::varchar, 10, '0') || 'I' || substr(b2.k, 11), o: list_prepend('user:', b2.o)},
               {k: lpad((left(b3.k, 10)::int + 10)::varchar, 10, '0') || 'II' || substr(b3.k, 11), o: ['user:', 'assistant:'] || b3.o}])[1],
    list_sort([b1, {k: lpad((left(b2.k, 10)::int + 5)::varchar, 10, '0') || 'I' || substr(b2.k, 11), o: list_prepend('user:', b2.o)},
               {k: lpad((left(b3.k, 10)::int + 10)::varchar, 10, '0') || 'II' || substr(b3.k, 11), o: ['user:', 'assistant:'] || b3.o}])[1],
    list_sort([b2, {k: lpad((left(b3.k, 10)::int + 5)::varchar, 10, '0') || 'I' || substr(b3.k, 11), o: list_prepend('assistant:', b3.o)}])[1],
    list_sort([b3, {k: lpad((left(b2.k, 10)::int + 5)::varchar, 10, '0') || 'I' || substr(b2.k, 11), o: list_prepend('user:', b2.o)}])[1]
  from (
    select conv_id, k,
      list_sort([d0, r2, case when i = 's' then k1 when i = 'u' then k2 else none end])[1] as b0,
      list_sort([d1, r2, case when i = 'u' then k2 else none end])[1] as b1,
      list_sort([d2, r3, case when i = 'a' then k3 else none end])[1] as b2,
      list_sort([d3, r2, case when i = 'u' then k2 else none end])[1] as b3
    from (
      select conv_id, k, i, none,
        {k: lpad((left(v0.k, 10)::int + 2)::varchar, 10, '0') || 'D' || substr(v0.k, 11), o: v0.o} as d0,
        {k: lpad((left(v1.k, 10)::int + 2)::varchar, 10, '0') || 'D' || substr(v1.k, 11), o: v1.o} as d1,
        {k: lpad((left(v2.k, 10)::int + 2)::varchar, 10, '0') || 'D' || substr(v2.k, 11), o: v2.o} as d2,
        {k: lpad((left(v3.k, 10)::int + 2)::varchar, 10, '0') || 'D' || substr(v3.k, 11), o: v3.o} as d3,
        case when f in ('b', 'd') then none else {k: lpad((left(v1.k, 10)::int + t)::varchar, 10, '0') || 'K' || substr(v1.k, 11), o: list_prepend(own, v1.o)} end as k1,
        case when f in ('b', 'd') then none else {k: lpad((left(v2.k, 10)::int + t)::varchar, 10, '0') || 'K' || substr(v2.k, 11), o: list_prepend(own, v2.o)} end as k2,
        case when f in ('b', 'd') then none else {k: lpad((left(v3.k, 10)::int + t)::varchar, 10, '0') || 'K' || substr(v3.k, 11), o: list_prepend(own, v3.o)} end as k3,
        case when f in ('b', 'd') then none else {k: lpad((left(v2.k, 10)::int + t + 1)::varchar, 10, '0') || 'R' || substr(v2.k, 11), o: list_prepend('user:' || text, v2.o)} end as r2,
        case when f in ('b', 'd') then none else {k: lpad((left(v3.k, 10)::int + t + 1)::varchar, 10, '0') || 'R' || substr(v3.k, 11), o: list_prepend('assistant:' || text, v3.o)} end as r3
      from (
        select p.*exclude (k), r.k, r.i, r.f, r.text, r.role || ':' || r.text as own, case when r.f = 't' then 5 else 0 end as t,
               {k: '9999999999', o: []::varchar[]} as none
        from plain p join faults r on r.conv_id is not distinct from p.conv_id and r.k = p.k - 1
      )
    )
  )
)
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
       coalesce(c.illegal, 0) as illegal, coalesce(left(p.v0.k, 10)::bigint, 0) as cost, coalesce(substr(p.v0.k, 11), '') as audit,
       sha256(coalesce(array_to_string(p.v0.o, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join plain p on p.conv_id is not distinct from o.conv_id and p.k = 1
""",
}
