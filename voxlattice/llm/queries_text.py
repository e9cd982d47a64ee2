"""Queries over the texts of the documents table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lm_scoring import score_texts
from .queries_data import BYTE_BPE, WORD_BPE
from .quality import fit_quality, score_quality
from .shingle_links import shingle_links
from .suffix_dedup import remove_repeats
from .surrogates import replace_entities
from .token_counts import count_tokens

#: The key of the surrogates: a secret of the deployment; this default serves tests.
SECRET = os.environ.get("VOXLATTICE_SECRET", "a key for tests").encode()


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "text_score", "metadata_score", "score", "kept")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, SECRET)


def op8_shingle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_links(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), BYTE_BPE, held_out)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return remove_repeats(docs, keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), WORD_BPE, 2048)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op6_lm_scores": op6_lm_scores, "op8_shingle_links": op8_shingle_links, "op2_surrogates": op2_surrogates, "op5_quality": op5_quality, "op13_token_counts": op13_token_counts}

SQL: dict[str, str] = {
    "op8_shingle_links": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) < 2 then [array_to_string(w, ' ')] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g
  from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
reach as (select a, a as b from links union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a, min(b) as c from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, d.doc_id = coalesce(c, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join component on component.a = d.doc_id
""",
}
