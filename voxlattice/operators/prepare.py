"""Relational preparation: contracts, alias resolution, stratified splits, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve(columns: list[str], *names: str, required: bool = True) -> str | None:
    """The column that matches one of the names first, whatever its case."""
    by_name = {c.lower(): c for c in reversed(columns)}
    found = next((by_name[n.lower()] for n in names if n.lower() in by_name), None)
    if required and found is None:
        raise ValueError(f"none of {names} among {columns}")
    return found


def family_of(name: Column) -> Column:
    """The upper-cased third part of C_12_opus_..., UNKNOWN where the name has another form."""
    return F.coalesce(F.upper(F.nullif(F.regexp_extract(name, r"^[CR]_\d+_([^_]+)_", 1), F.lit(""))), F.lit("UNKNOWN"))


def unresolved(rows: DataFrame, known: DataFrame, key: str, most: int = 8) -> DataFrame:
    return rows.join(known, key, "left_anti").select(key).distinct().orderBy(key).limit(most)


def stratified_split(rows: DataFrame, family: str, condition: str) -> DataFrame:
    """rows with split: of a family's n conditions in order, the last round-half-even(.15 n) (at least 1, if n >= 3) are
    test, as many before them dev (if n >= 4), the rest train. Conditions are ranked, not rows: the ranked table has a
    row for each condition."""
    conditions = rows.select(family, condition).distinct()
    place, all_ = W.partitionBy(family).orderBy(condition), W.partitionBy(family)
    ranked = conditions.withColumn("at", F.row_number().over(place)).withColumn("of", F.count("*").over(all_))
    share = F.greatest(F.lit(1), F.bround(F.col("of") * 0.15).cast("int"))
    test, dev = F.when(F.col("of") >= 3, share).otherwise(0), F.when(F.col("of") >= 4, share).otherwise(0)
    split = F.when(F.col("at") > F.col("of") - test, "test").when(F.col("at") > F.col("of") - test - dev, "dev").otherwise("train")
    return rows.join(ranked.select(family, condition, split.alias("split")), [family, condition])


def ensure(rows: DataFrame, holds: Column, message: str) -> DataFrame:
    """The rows, as a plan that fails with the message where a row breaks the rule."""
    return rows.where(F.when(holds, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def ensure_count(rows: DataFrame, n: int) -> DataFrame:
    found = rows.count()
    if found != n:
        raise ValueError(f"{found} rows, not {n}")
    return rows


def attach_by_id(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores by an explicit id, never by position."""
    return rows.join(scores, key, "left")
