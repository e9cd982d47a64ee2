"""Fusion of penalties into a quality estimate, hinge features and their application. Models are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlattice.functions.columns import clamp

# Default weights of the base estimate and of the final fusion.
BASE = {"bias": 0.02, "missing": 1.05, "added": 0.68, "coloration": 0.45, "noisiness": 0.55, "discontinuity": 0.95, "loudness": 0.35, "clipping": 0.65, "bad_section": 0.80, "expert": 1.00}
FINAL = {
    "bias": 0.0, "base": 0.58, "multi_resolution": 0.3864, "temporal": 0.2688, "modulation": 0.1680, "asymmetry": 0.3192, "tilt": 0.1344,
    "level": 0.1680, "bad_interval": 0.2352, "echo": 0.40, "choppiness": 0.40, "residual": 0.20,
}
# The features of the hinge model, in order, and its knots.
FEATURES = [
    "base", "missing", "added", "coloration", "noisiness", "discontinuity", "loudness", "clipping", "bad_section", "multi_resolution", "temporal",
    "modulation", "asymmetry", "tilt", "level", "bad_interval", "echo", "choppiness", "residual", "visqol_speech", "visqol_audio",
]
# The names that model files give the derived terms, in order.
DERIVED = ["__max", "__top3mean", "__echo_base", "__chop_bad", "__res_noise", "__clip_bad", "__visqol_base"]
KNOTS = [0.0, 0.15, 0.30, 0.45, 0.60, 0.75]


def base_mos(weights: dict[str, float] = BASE, expert: Column | None = None) -> Column:
    """From columns named as the weights, all degradations in [0, 1]."""
    penalty = F.lit(weights["bias"])
    for name in list(BASE)[1:-1]:
        penalty = penalty + weights[name] * F.col(name)
    if expert is not None:
        penalty = penalty + F.coalesce(max(0.0, weights["expert"]) * clamp((5 - expert) / 4), F.lit(0.0))
    return clamp(5 - penalty, 1, 5)


def final_mos(base: Column, weights: dict[str, float] = FINAL) -> Column:
    """The base estimate's penalty and the advanced degradations, no weight below zero."""
    penalty = F.lit(max(0.0, weights["bias"])) + max(0.0, weights["base"]) * clamp(5 - base, 0, 4)
    for name in list(FINAL)[2:]:
        penalty = penalty + max(0.0, weights[name]) * F.col(name)
    return clamp(5 - penalty, 1, 5)


def derived() -> list[Column]:
    """The interactions of the features, as columns."""
    top = F.slice(F.sort_array(F.array(*FEATURES), asc=False), 1, 3)
    products = [("echo", "base"), ("choppiness", "bad_interval"), ("residual", "noisiness"), ("clipping", "bad_interval"), ("visqol_speech", "base")]
    found = [F.greatest(*FEATURES), F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / 3, *(F.col(a) * F.col(b) for a, b in products)]
    return [x.alias(name) for x, name in zip(found, DERIVED, strict=True)]


def hybrid_features() -> list[Column]:
    """The hinge model's features out of a result's fields (mos, disturbances, dimensions, ratios, similarities) and the
    experts' scores, each in [0, 1]: 0 is no degradation."""
    lack = lambda score: (5 - F.col(score)) / 4
    found = {
        "base": lack("mos"), "missing": F.col("missing_disturbance"), "added": F.col("added_disturbance"), "coloration": lack("dim_coloration"),
        "noisiness": lack("dim_noisiness"), "discontinuity": lack("dim_discontinuity"), "loudness": lack("dim_loudness"), "clipping": F.col("clipping_ratio") * 40,
        "bad_section": F.col("bad_section_fraction"), "multi_resolution": 1 - F.col("multi_resolution_similarity"), "temporal": 1 - F.col("temporal_envelope_similarity"),
        "modulation": 1 - F.col("modulation_similarity"), "asymmetry": F.col("asymmetric_disturbance"), "tilt": F.col("spectral_tilt_error"), "level": F.col("active_level_delta_db") / 18,
        "bad_interval": F.col("bad_interval_severity"), "echo": F.col("echo_score"), "choppiness": F.col("choppiness_score"), "residual": F.col("residual_intrusion"),
        "visqol_speech": lack("visqol_speech_mos"), "visqol_audio": lack("visqol_audio_mos"),
    }
    return [clamp(found[name]).alias(name) for name in FEATURES]


def bases() -> list[Column]:
    """max(0, feature - knot) for all features, derived ones too, and for each all knots: what the hinge model's fit sees."""
    top = dict(zip(DERIVED, derived(), strict=True))
    return [F.greatest(F.lit(0.0), (top[c] if c in top else F.col(c)) - F.lit(k)) for c in [*FEATURES, *DERIVED] for k in KNOTS]


def hinges(rows: DataFrame, key: str) -> DataFrame:
    """key, feature, knot, value: max(0, feature - knot) for all features and knots."""
    wide = rows.select(key, *FEATURES, *derived())
    long = wide.unpivot([key], [*FEATURES, *DERIVED], "feature", "x")
    return long.select(key, "feature", "x", F.explode(F.array(*map(F.lit, KNOTS))).alias("knot")).select(key, "feature", "knot", F.greatest(F.lit(0.0), F.col("x") - F.col("knot")).alias("value"))


def hinge_means(rows: DataFrame) -> DataFrame:
    """feature, knot, mean: of hinges() over all rows, as one aggregate; no value is a row. A row with a null counts for
    its other features."""
    names = [*FEATURES, *DERIVED]
    wide = rows.select(*FEATURES, *derived())
    levels = lambda c: F.array(*[F.avg(F.greatest(F.lit(0.0), F.col(c) - F.lit(k))) for k in KNOTS]).alias(c)
    found = wide.agg(F.count("*").alias("_rows"), *map(levels, names)).where("_rows > 0")
    long = found.unpivot([], names, "feature", "means").select("feature", F.posexplode("means").alias("at", "mean"))
    return long.select("feature", F.get(F.array(*map(F.lit, KNOTS)), F.col("at")).alias("knot"), "mean")


def hinge_mos(model: DataFrame, bias: float) -> Column:
    """The hinge model's estimate, as one expression over the features. model: feature, knot, weight (a few hundred rows
    at most, by the number of features and knots; other features are refused)."""
    terms = sorted(map(tuple, model.where("weight > 0").select("feature", "knot", "weight").collect()))
    own = dict(zip(DERIVED, derived(), strict=True)) | {name: F.col(name) for name in FEATURES}
    if unknown := {name for name, _, _ in terms} - set(own):
        raise ValueError(f"no such features: {sorted(unknown)}")
    penalty = F.lit(float(bias))
    for name, knot, weight in terms:
        penalty = penalty + weight * F.greatest(F.lit(0.0), own[name] - F.lit(knot))
    return clamp(5 - penalty, 1, 5)


def apply_hinges(rows: DataFrame, key: str, model: DataFrame, bias: float) -> DataFrame:
    """key, mos."""
    return rows.select(key, hinge_mos(model, bias).alias("mos"))
