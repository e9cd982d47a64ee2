"""Files of the evaluation: WAV recordings, key=value calibrations, model JSON, manifests and reports."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WAV = "struct<sample_rate: int, samples: array<float>, error: string>"


def decode_wav(data: bytes, truncating: bool = False) -> tuple[int | None, np.ndarray | None, str | None]:
    """Rate, mono samples and no error; or what is wrong. PCM16 and IEEE float32 alone; channels are averaged. Truncating:
    PCM16 alone, and a mean of channels is cut to a whole 16-bit value, towards zero."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, None, "invalid WAV"
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        part = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(part) >= 16:
            form = struct.unpack_from("<HHIIHH", part)
        elif name == b"data":
            body = part
        at += 8 + size + size % 2
    if form is None or body is None or not form[1] or not form[2]:
        return None, None, "incomplete WAV"
    kind, channels, rate, *_, bits = form
    if (kind, bits) not in ((1, 16), (3, 32)):
        return None, None, "WAV must be PCM16 or IEEE float32"
    if truncating and bits != 16:
        return None, None, "WAV must be PCM16"
    flat = np.frombuffer(body[: len(body) // (bits // 8 * channels) * (bits // 8 * channels)], "<i2" if bits == 16 else "<f4").astype(np.float64)
    mono = flat.reshape(-1, channels).sum(1) / channels
    samples = (np.trunc(mono) if truncating else mono) / (32768 if bits == 16 else 1)
    return rate, samples.astype(np.float32), None


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono PCM16, clamped to what 16 bits hold."""
    pcm = np.rint(np.clip(samples, -0.999969, 0.999969) * 32768).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def read_wavs(spark: SparkSession, path: str, truncating: bool = False) -> DataFrame:
    """path, wav (rate, samples, error) of all WAV files below a folder; broken files are rows with an error."""

    @F.pandas_udf(WAV)
    def decoded(content: pd.Series) -> pd.DataFrame:
        rows = [decode_wav(bytes(x), truncating) for x in content]
        return pd.DataFrame({"sample_rate": pd.array([r[0] for r in rows], "Int32"), "samples": [None if r[1] is None else r[1].tolist() for r in rows], "error": [r[2] for r in rows]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", decoded("content").alias("wav"))


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The files of a pattern, with a header, as text columns; a byte-order mark before the first name is taken off, and
    columns that are asked for must be there."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.removeprefix("\ufeff").strip() for c in rows.columns])
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return rows


def write_calibration(weights: DataFrame, figures: dict[str, float], path: str) -> None:
    """key=value lines of nine decimals, the figures of the fit after them, in one file."""
    more = weights.sparkSession.createDataFrame(list(figures.items()), "key string, value double")
    lines = weights.select("key", F.col("value").cast("double").alias("value")).unionByName(more)
    lines.select(F.format_string("%s=%.9f", "key", "value").alias("value")).coalesce(1).write.text(path)


def calibration(lines: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """key, value for each default, overridden by key=value lines (columns line_no, value): blanks, comments and lines
    without = are skipped, the last of a key wins, other keys are ignored; a value that is no number fails."""
    parts = F.split(F.trim("value"), "=", 2)
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#") & F.col("value").contains("="))
    pairs = kept.select("line_no", F.trim(parts[0]).alias("key"), F.trim(parts[1]).cast("double").alias("given"))
    last = pairs.groupBy("key").agg(F.max_by("given", "line_no").alias("given"))
    known = lines.sparkSession.createDataFrame(list(defaults.items()), "key string, fallback double")
    return known.join(last, "key", "left").select("key", F.coalesce("given", "fallback").alias("value"))


def model_terms(models: DataFrame) -> DataFrame:
    """feature, knot, weight out of a model's JSON (features, derived_names, knots, weights; weights run over the
    features and, within one, the knots)."""
    names = F.concat("features", "derived_names")
    terms = models.select(names.alias("names"), "knots", F.posexplode("weights").alias("at", "weight"))
    width = F.size("knots")
    return terms.select(F.get("names", F.floor(F.col("at") / width).cast("int")).alias("feature"), F.get("knots", F.col("at") % width).alias("knot"), "weight")


def report(row: Column) -> Column:
    """A nested report as JSON; nulls are left out."""
    return F.to_json(row)


def numbered_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")


def last_of_name(files: DataFrame) -> DataFrame:
    """One path for each base name, the last in order."""
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).groupBy("name").agg(F.max("path").alias("path"))


def row_ids(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("row_id", F.row_number().over(W.orderBy(*order)))
