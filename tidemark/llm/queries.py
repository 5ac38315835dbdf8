"""The training-data queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, divergence, folds, jaccard, licenses, maxent, mixing, packing, quality, sketch, suffix, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    return found.withColumn("rank", F.col("rank").cast("int"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_table(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"))
    passes = {name: F.round(F.get("positions", F.lit(k)), 6) for k, name in enumerate(("position", "second_position"))}
    return out.withColumns({"target": F.round("target", 6), **passes}).drop("positions")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprinted(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_removed(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def op12_filter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_score, op2_license_scan, op3_topk_search, op4_chat_repair, op5_quality, op6_mixing, op7_jaccard_join, op8_fingerprints, op9_suffix_dedup, op10_packing, op11_divergence, op12_filter_folds, op13_toxicity)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

MIXING = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, text, '')) as digest from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
p as (select *, (row_number() over (order by source is null, source) - 1) as place from s),
w as (select *, [5.0, 2.0, 1.0][place % 3 + 1]::double as weight, 2.0::double * source_size as most from p),
r as (select *, row_number() over (order by most / weight, place) as k from w),
l as (select k, most / weight as ratio, (1.5::double * (select sum(source_size) from w)::double - coalesce(sum(most) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by k rows between current row and unbounded following) as share from r),
t as (select r.*, least(most, weight * (select share from l where ratio >= share order by k limit 1)) as target from r),
c as (select row_number() over () as id, d.doc_id, d.size, t.source_size, t.target, t.place, coalesce(sum(d.size) over (partition by d.source order by digest, size rows between unbounded preceding and 1 preceding), 0)::bigint as begins
      from d join t on d.source is not distinct from t.source),
e as (select id, pass, size, target, place, begins + pass * source_size as begins, greatest(0, least(size, floor(target)::bigint - begins - pass * source_size)) as took from c, (select unnest([0, 1]) as pass)),
u as (select id, pass, took, case place % 3 when 0 then 1.5 - sqrt(2.25 - 2 * begins / target) when 1 then begins / target else sqrt(0.25 + 2 * begins / target) - 0.5 end as read_at from e where took > 0),
g as (select id, sum(took) as taken, min(read_at) filter (pass = 0) as position, min(read_at) filter (pass = 1) as second_position from u group by id)
select doc_id, size, source_size, round(target, 6) as target, coalesce(g.taken, 0)::bigint as taken, round(position, 6) as position, round(second_position, 6) as second_position
from c left join g on g.id = c.id
"""

JACCARD = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as s from w),
x as (select doc_id, len(s) as n, md5(unnest(s)) as h from s),
p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r as (select doc_id, doc_id as reached from s union select r.doc_id, p.b from r join p on p.a = r.reached)
select s.doc_id, len(s.s)::bigint as n_shingles, (select min(reached) from r where r.doc_id = s.doc_id) as component_id from s
"""

SUFFIX = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
b as (select doc_id, n, b, substr(h, 2 * b + 1, 398) as part from (select doc_id, n, h, unnest(range(0, n - 99, 100)) as b from d where n >= 100)),
i as (select doc_id, b + r as i, md5(substr(part, 2 * r + 1, 200)) as m from (select doc_id, n, b, part, unnest(range(0, 100)) as r from b) where b + r + 100 <= n),
w as (select doc_id, i, row_number() over (partition by m order by doc_id, i) as k from i),
g as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as new from w where k > 1),
o as (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from g),
r as (select doc_id, min(i) as a, max(i) + 100 as b from o group by doc_id, run),
q as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from r),
k as (select q.doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept
      from q join d on d.doc_id = q.doc_id group by q.doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join k on k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    out = {"op3_topk_search": TOP_K, "op6_mixing": MIXING, "op7_jaccard_join": JACCARD, "op8_fingerprints": sketch.sql(), "op9_suffix_dedup": SUFFIX, "op11_divergence": divergence.SQL, "op12_filter_folds": folds.SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
