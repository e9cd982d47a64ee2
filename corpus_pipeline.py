"""From raw documents to packed training sequences: five stages, each a Spark job whose output is written before the next
one reads it.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. Stage by stage: documents that the co-trained classifier rejects go; one document of each
group of near duplicates stays (five-word shingles, similarity 0.8 or more); personal data get surrogates; sources are
mixed to target weights, a document as often as it is taken; all texts are packed into sequences of 1024 tokens.

No stage depends on the order or partitioning of its input. Nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns are handled as each operator's docstring says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlattice.llm.common import Scratch, table
from voxlattice.llm.mixing import mix_sources
from voxlattice.llm.packing import best_fit_packing
from voxlattice.llm.quality import fit_quality, score_quality
from voxlattice.llm.queries_data import BYTE_BPE
from voxlattice.llm.queries_text import SECRET
from voxlattice.llm.shingle_links import drop_near_duplicates
from voxlattice.llm.surrogates import replace_entities


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    seen = docs.select("doc_id", "text", "source", "lang", "n_chars")
    model = fit_quality(seen, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("whole_row"), *seen.columns)
    return score_quality(rows, model).where("kept").select("whole_row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, width=5, percent=80)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = replace_entities(docs, SECRET, count_col="_replaced")
    changed = F.when(F.col("_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, BYTE_BPE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii_surrogates", pii_surrogates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", sequence_packing),
]

#: The classifier is fitted by descent, which SQL does not express; tests/llm/test_pipeline.py holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return docs
