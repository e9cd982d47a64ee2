"""Queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hard_negatives import hard_negatives
from .topk import exact_top_k
from .vector_links import sound, vector_links
from .whitening import whiten, whole_numbers


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(sound(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")))
    return exact_top_k(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 20 == 0)


def op7_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(sound(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(whole_numbers(table(spark, sf_dir, "embeddings"), 1024, 100_000))
    return found.withColumn("deviation", F.col("deviation").cast("long"))  # an error, not another number, beyond 64 bits


QUERIES = {"op4_exact_top_k": op4_exact_top_k, "op7_vector_links": op7_vector_links, "op11_hard_negatives": op11_hard_negatives, "op12_whitening": op12_whitening}

#: op12 has none: SQL does not solve for eigenvectors (tests/llm/test_vectors.py holds it against a dense solver).
SQL = {
    "op4_exact_top_k": """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.row as query_row, a.vec_id as query_id, b.row, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.row <> b.row and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_row order by score desc, vec_id, row) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 20
""",
    "op7_vector_links": """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.95),
reach as (select a, a as b from links union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a, min(b) as c from reach group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(c, e.vec_id) as component_id, e.vec_id = coalesce(c, e.vec_id) as kept
from embeddings e left join counts on counts.a = e.vec_id left join component on component.a = e.vec_id
""",
    "op11_hard_negatives": """
with v as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.row as anchor, a.vec_id as anchor_id, a.label = b.label as same, b.row, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.row <> b.row and len(a.q) = len(b.q) where a.label is not null and b.label is not null),
p as (
  select anchor, anchor_id, row, vec_id as positive_id, score as positive_score,
    row_number() over (partition by anchor order by score desc, vec_id nulls last, row) as place from s where same qualify place <= 5),
n as (
  select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
    row_number() over (partition by anchor, p.place order by score desc, vec_id nulls last, s.row) as rank
  from p join (select anchor, row, vec_id, score from s where not same) s using (anchor)
  where 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
}
