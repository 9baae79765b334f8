"""Queries of the operators in this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, hard_negatives, language_model, licenses, minhash, packing, quality, recompress, simhash, substrings, target_sampling, topk
from .shared import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", packing.token_count().alias("n_tokens"))
    return packing.pack(docs)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("vector"))
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.top_k(vectors, asked, 5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(spread(_table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompress.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "importance.log_weight", "importance.gumbel_key", F.col("importance.drawn").alias("selected"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("vector"), moved.cast("long").alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives.mine(rows)


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = target_sampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_bpe": op3_bpe,
    "op4_recompress": op4_recompress,
    "op5_language_model": op5_language_model,
    "op6_licenses": op6_licenses,
    "op7_suffixes": op7_suffixes,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_minhash": op10_minhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_target_sampling": op12_target_sampling,
    "op13_decontaminate": op13_decontaminate,
}

SQL: dict[str, str] = {
    "op1_packing": f"""
with recursive whole as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 as n from documents
), pieces as (
  select doc_id, cast(p as integer) as piece, least({packing.MAX_LEN}, n - p * {packing.MAX_LEN}) as n_tokens
  from whole, lateral (select unnest(range(0, cast(ceil(n / {packing.MAX_LEN}.0) as bigint))) as p)
), hist as (
  select n_tokens as len, row_number() over (order by n_tokens) as j,
         sum(count(*)) over (order by n_tokens) as upto
  from pieces group by n_tokens
), dp as (
  select 1 as b, j, len * upto as cost, cast([len] as bigint[]) as bounds from hist
  union all
  select d.b + 1, h.j, min(d.cost + h.len * (h.upto - p.upto)),
         list_append(arg_min(d.bounds, struct_pack(c := d.cost + h.len * (h.upto - p.upto), i := d.j)), h.len)
  from dp d join hist p on p.j = d.j join hist h on h.j > d.j
  where d.b < {packing.BUCKETS}
  group by d.b, h.j, h.len, h.upto
), best as (
  select bounds from dp where j = (select max(j) from hist) order by cost, b limit 1
), placed as (
  select p.*, len(list_filter(bounds, lambda x: x < n_tokens)) as bucket, bounds from pieces p, best
), ranked as (
  select *, bounds[bucket + 1] as bucket_len,
         row_number() over (partition by bucket order by doc_id nulls first, piece, n_tokens) - 1 as r
  from placed
)
select doc_id, piece, n_tokens, cast(bucket as integer) as bucket, bucket_len,
       r // greatest(1, {packing.BATCH_TOKENS} // greatest(bucket_len, 1)) as batch,
       r % greatest(1, {packing.BATCH_TOKENS} // greatest(bucket_len, 1)) as slot
from ranked
""",
    "op2_topk": """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.n <> c.n where q.vec_id % 50 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id nulls last) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
    "op6_licenses": licenses.oracle_sql(),
    "op11_hard_negatives": """
with v as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.n as a, a.vec_id as anchor_id, c.n as c, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score
  from v a join v c on a.n <> c.n where a.vec_id % 100 = 0
), positives as (
  select * from (select *, row_number() over (partition by a order by score desc, vec_id nulls last, c) as place from scored where same) where place <= 5
), windows as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
         cast(row_number() over (partition by p.a, p.c order by s.score desc, s.vec_id nulls last, s.c) as integer) as rank
  from positives p join scored s on s.a = p.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from windows where rank <= 10
""",
    "op12_target_sampling": target_sampling.oracle_sql(),
    "op13_decontaminate": contamination.oracle_sql(),
    "op4_recompress": f"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), windows as (
  select doc_id, p, md5(array_to_string(list_slice(w, p, p + {recompress.WINDOW - 1}), ' ')) as k
  from docs, lateral (select unnest(range(1, len(w) - {recompress.WINDOW - 2})) as p)
), starts as (
  select doc_id, p, row_number() over (partition by k order by doc_id, p) > 1 as later from windows
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs
), covered as (
  select x.doc_id, x.p, word, coalesce(max(cast(later as integer)) over (partition by x.doc_id order by x.p rows between {recompress.WINDOW - 1} preceding and current row), 0) as gone
  from words x left join starts s on s.doc_id = x.doc_id and s.p = x.p
), kept as (
  select doc_id, cast(sum(gone) as bigint) as n_removed, coalesce(string_agg(case when gone = 0 then word end, ' ' order by p), '') as text from covered group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (doc_id)
""",
}
