"""Analysis of (reference, degraded) pairs. The kernel does what columns cannot (resampling, alignment, spectra) for a
batch of pairs and emits one row a frame: levels and band energies, beside what holds for the pair, and the rows of the
advanced analysis, whose delay the same pass has found. Everything after it is a query over those rows, which are
staged once. A pair that cannot be analysed (a rate that is not positive, an empty signal) has one row that says why; it
does not fail the others."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.functions.columns import array_pearson, clamp, db
from voxlattice.operators.advanced import PARTS as ADVANCED
from voxlattice.operators.advanced import Piece, batched, diagnostics, floats, part_pieces, resample_linear
from voxlattice.operators.evaluate import r6
from voxlattice.operators.fusion import FINAL, base_mos, final_mos, hybrid_features
from voxlattice.operators.order_statistics import order_statistics
from voxlattice.operators.signal import compare_frame, dimensions, events
from voxlattice.session import staged

RATE, FRAME, HOP, BANDS = 48_000, 960, 480, 32
# Bins of an envelope a second; the longest delay in them; parts of a recording that are aligned apart.
ENVELOPE, LONGEST, ALIGNED = 200, 300, 5
FRAMES = (
    "pair_id string, i int, ref_rms double, deg_rms double, a array<double>, b array<double>, peak double, floor double, delay_ms double, drift_ppm double, "
    "clipped double, seconds double, bandwidth string, error string, kind string, x double, y double, z double"
)
assert {c.strip() for c in ADVANCED.split(",")} <= {c.strip() for c in FRAMES.split(",")}


def resample_sinc(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Hann-windowed sinc of 32 taps (the window reaches zero 16 places away), weights renormalised, back in float32."""
    if rate <= 0 or to <= 0:
        raise ValueError("a rate must be positive")
    if rate == to or not len(x):
        return x.astype(np.float32)
    shared = gcd(rate, to)
    up, down, n = to // shared, rate // shared, int(np.floor(len(x) * (to / rate) + 0.5))
    # Outputs `up` apart lie equally between samples: a row of weights for each of `up` phases serves all of them.
    phase, taps = np.arange(min(up, n)), np.arange(-15, 17)
    away = (phase * down % up / up)[:, None] - taps
    cut = min(1.0, to / rate) * 0.94
    w = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * away / 16))
    windows = sliding_window_view(np.concatenate([np.zeros(15), x, np.zeros(16)]), 32)
    out = np.empty(n)
    for first in phase.tolist():
        out[first::up] = windows[first * down // up :: down][: -(-(n - first) // up)] @ w[first]
    begin = np.arange(n) * down // up
    sums = w.sum(1)[np.arange(n) % up]
    ends = np.flatnonzero((begin < 15) | (begin + 16 >= len(x)))  # taps beyond the signal do not count
    near = begin[ends, None] + taps
    sums[ends] = (w[ends % up] * ((near >= 0) & (near < len(x)))).sum(1)
    return (out / sums).astype(np.float32)


def prepare(x: np.ndarray, rate: int) -> np.ndarray:
    x = resample_sinc(np.asarray(x, np.float64), rate, RATE).astype(np.float64)
    return (x - x.mean()).astype(np.float32).astype(np.float64)


def delay_bins(a: np.ndarray, b: np.ndarray, lags: range) -> tuple[int, float]:
    """The shift of b against a with the largest uncentred correlation, of equal ones the lowest; and that correlation. a
    is indexed from `lags`' own zero: b may begin before it."""
    lag = np.arange(lags.start, lags.stop)
    first, last = np.maximum(0, -lag), np.minimum(len(a), len(b) - lag)  # the places of a that meet b
    n = np.maximum(0, last - first)
    first, last = np.minimum(first, len(a)), np.maximum(last, np.minimum(first, len(a)))
    square = lambda x: np.concatenate([[0.0], np.cumsum(x * x)])
    aa, bb = square(a), square(b)
    at = lambda sums, place: sums[np.clip(place, 0, len(sums) - 1)]
    xx, yy = at(aa, last) - at(aa, first), at(bb, last + lag) - at(bb, first + lag)
    before = max(0, -lags.start)
    padded = np.concatenate([np.zeros(before), b, np.zeros(max(0, len(a) + lags.stop - 1 - len(b)))])
    met = sliding_window_view(padded, len(a))[lag[0] + before : lag[-1] + before + 1] if len(a) else np.zeros((len(lag), 0))
    xy = np.einsum("ln,n->l", met, a)
    use = (n >= 8) & (xx >= 1e-12) & (yy >= 1e-12)
    c = np.where(use, xy / np.sqrt(np.where(use, xx * yy, 1.0)), -1.0)
    best = int(np.argmax(np.round(c, 12)))
    return int(lag[best]), float(c[best])


def alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Of two envelopes: the delay in bins, and the drift in millionths from the delays of parts around it."""
    whole, _ = delay_bins(a, b, range(-LONGEST, LONGEST + 1))
    middles, delays = [], []
    radius = ENVELOPE // 20
    for part in range(ALIGNED):
        begin, end = len(a) * part // ALIGNED, len(a) * (part + 1) // ALIGNED
        if end <= begin + 20:
            continue
        # The part's own lag 0 is lag `begin` of b.
        lag, c = delay_bins(a[begin:end], b, range(begin + whole - radius, begin + whole + radius + 1))
        if c > 0.15:
            middles.append((begin + end) / 2 / ENVELOPE)
            delays.append((lag - begin) / ENVELOPE)
    if len(middles) < 3:
        return whole, 0.0
    t = np.array(middles) - np.mean(middles)
    square = (t * t).sum()
    return whole, float(np.clip((t * (np.array(delays) - np.mean(delays))).sum() / square * 1e6, -5000, 5000)) if square > 1e-12 else 0.0


@lru_cache
def band_edges() -> list[tuple[int, int]]:
    low, top, out = 50.0, min(20_000.0, RATE / 2 * 0.98), []
    size = 1 << (FRAME - 1).bit_length()
    for band in range(BANDS):
        lo, hi = (low * (top / low) ** (k / BANDS) for k in (band, band + 1))
        k0 = min(int(lo * size / RATE), size // 2)
        out.append((k0, min(max(int(np.ceil(hi * size / RATE)), k0 + 1), size // 2 + 1)))
    return out


def bands(frames: np.ndarray) -> np.ndarray:
    """dB in log-spaced bands of Hann-windowed frames."""
    size = 1 << (FRAME - 1).bit_length()
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), size)) ** 2 + 1e-14
    sums = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(power, 1)], 1)
    first, last = np.array(band_edges()).T
    return 10 * np.log10((sums[:, last] - sums[:, first]) / (last - first) + 1e-14)


def _rms(frames: np.ndarray) -> np.ndarray:
    return np.sqrt((frames * frames).mean(-1))


def _db(x: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(x, 1e-9))


def _envelope(x: np.ndarray) -> np.ndarray:
    at = np.arange(0, len(x), RATE // ENVELOPE)
    return np.add.reduceat(np.abs(x), at) / np.minimum(RATE // ENVELOPE, len(x) - at)


def similarity(a: np.ndarray, b: np.ndarray, rms_a: np.ndarray, rms_b: np.ndarray) -> np.ndarray:
    """compare_frame()'s similarity of many frames: what local alignment chooses by."""
    x, y = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
    xx, yy = (x * x).sum(-1), (y * y).sum(-1)
    r = np.where((xx >= 1e-12) & (yy >= 1e-12), (x * y).sum(-1) / np.sqrt(np.maximum(xx * yy, 1e-300)), 0)
    level = np.clip(np.abs(_db(rms_b + 1e-9) - _db(rms_a + 1e-9)) / 24, 0, 1)
    return np.clip(0.75 * (np.clip(r, -1, 1) + 1) / 2 + 0.25 * (1 - level), 0, 1)


def bandwidth(x: np.ndarray) -> str:
    """NB, WB, SWB or FB of up to four seconds, by the share of power above 3.4, 7 and 14 kHz."""
    x = x[: RATE * 4]
    size = 1 << max(0, len(x) - 1).bit_length()
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)), size)) ** 2 + 1e-14
    top = min(len(power), int(np.ceil(20_000 * size / RATE)))
    above = lambda low: power[min(len(power) - 1, int(low * size / RATE)) : top].sum()
    whole = above(80) + 1e-12
    for name, low, share in (("NB", 3400, 0.003), ("WB", 7000, 0.003), ("SWB", 14_000, 0.002)):
        if above(low) / whole < share:
            return name
    return "FB"


def frame_rows(pair_id: str, ref: np.ndarray | None, ref_rate: int | None, deg: np.ndarray | None, deg_rate: int | None) -> Piece:
    """What holds for the pair, and columns of its active frames, each with the degraded frame that fits it best; a pair without one has a row without."""
    bad = "invalid sample rate" if not all(r and r > 0 for r in (ref_rate, deg_rate)) else "empty audio" if any(x is None or not len(x) for x in (ref, deg)) else None
    own = {"kind": "base", "pair_id": pair_id, "peak": 0.0, "floor": 0.0, "delay_ms": 0.0, "drift_ppm": 0.0, "clipped": 0.0, "seconds": 0.0, "bandwidth": None, "error": bad}
    if bad:
        return own, {"i": [None]}
    a, b = prepare(ref, ref_rate), prepare(deg, deg_rate)
    shift, drift = alignment(_envelope(a), _envelope(b))
    cut = np.arange(FRAME)
    starts = np.arange(0, len(a) - FRAME + 1, HOP)
    level = _rms(a[starts[:, None] + cut]) if len(starts) else np.zeros(0)
    heard = np.arange(0, len(b) - FRAME + 1, HOP)
    floors = np.sort(_db(_rms(b[heard[:, None] + cut]) + 1e-9)) if len(heard) else np.zeros(1)
    peak = float(level.max()) if len(level) else 0.0
    own |= {
        "peak": peak, "floor": float(floors[int(0.15 * (len(floors) - 1))]), "delay_ms": shift * 1000.0 / ENVELOPE, "drift_ppm": drift,
        "clipped": float((np.abs(b.astype(np.float32)) >= np.float32(0.995)).mean()), "seconds": len(b) / RATE, "bandwidth": bandwidth(b),
    }
    away = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)  # noqa: E731  halves away from zero
    there = (starts + away(shift * RATE / ENVELOPE) + away(starts * drift * 1e-6)).astype(np.int64)
    use = (_db(level) >= max(-55.0, float(_db(np.array(peak + 1e-9))) - 36)) & (there >= 0) & (there + FRAME <= len(b))
    starts, there, level = starts[use], there[use], level[use]
    if not len(starts):
        return own, {"i": [None]}
    x = bands(a[starts[:, None] + cut])
    found, loud = bands(b[there[:, None] + cut]), _rms(b[there[:, None] + cut])
    best, moves = similarity(x, found, level, loud), loud > 0.2 * level
    deltas = np.arange(-RATE // 100, RATE // 100 + 1, RATE // 1000)  # ten milliseconds either way, one at a time
    for some in range(0, len(starts), 1024):
        moving = some + np.flatnonzero(moves[some : some + 1024])
        places = there[moving, None] + deltas
        fits = (places >= 0) & (places + FRAME <= len(b))
        each = np.unique(places[fits])  # neighbours look at the same places: each is transformed once
        spectra, levels = bands(b[each[:, None] + cut]) if len(each) else np.zeros((0, BANDS)), _rms(b[each[:, None] + cut])
        for k in range(len(deltas)):
            at = moving[fits[:, k]]
            here = np.searchsorted(each, places[fits[:, k], k])
            spectrum, rms = spectra[here], levels[here]
            better = (s := similarity(x[at], spectrum, level[at], rms)) > best[at]
            at = at[better]
            best[at], found[at], loud[at] = s[better], spectrum[better], rms[better]
    return own, {"i": (starts // HOP).astype(np.int32), "ref_rms": level, "deg_rms": loud, "a": x, "b": found}


def advanced_rows(pair_id: str, ref: np.ndarray, ref_rate: int, deg: np.ndarray, deg_rate: int, delay_ms: float) -> list[Piece]:
    """What the advanced analysis sees: the recordings as they are, at one rate, with the delay that was found."""
    r, d = (resample_linear(np.asarray(x, np.float64), rate, RATE) for x, rate in ((ref, ref_rate), (deg, deg_rate)))
    return [(own | {"pair_id": pair_id}, columns) for own, columns in part_pieces(r, d, RATE, round(delay_ms * RATE / 1000))]


def frames(pairs: DataFrame, more: bool = True) -> DataFrame:
    """pairs: pair_id, ref and deg (structs of sample_rate and samples) -> rows of kind `base`, one a frame, and (where
    `more`) those of the advanced analysis."""
    kind = pairs.schema["pair_id"].dataType.simpleString()
    schema = FRAMES.replace("pair_id string", f"pair_id {kind}", 1)

    def told(batch: pa.RecordBatch) -> Iterator[Piece]:
        for pair, ref, deg in zip(batch["pair_id"].to_pylist(), batch["ref"], batch["deg"], strict=True):
            signals = []
            for x in (ref, deg):
                samples, rate = (x["samples"], x["sample_rate"].as_py()) if x.is_valid else (None, None)
                signals += [floats(samples.values) if samples is not None and samples.is_valid else None, rate]
            base = frame_rows(pair, *signals)
            yield base
            if more and base[0]["error"] is None:
                yield from advanced_rows(pair, *signals, base[0]["delay_ms"])

    return pairs.select("pair_id", "ref", "deg").mapInArrow(lambda batches: batched(map(told, batches), schema), schema)


def analyse(pairs: DataFrame) -> DataFrame:
    """pair_id, mos, confidence, delay, drift, bandwidth, the four dimensions, disturbances, ratios and events (type,
    start_ms, duration_ms, severity) of each pair. Without an active frame: mos 1, confidence 0, dimensions 1, no
    disturbance, no event; with an error, nothing but the error."""
    return base_results(staged(frames(pairs, more=False), "frames"))


def base_results(rows: DataFrame) -> DataFrame:
    """analyse() of staged frame rows."""
    rows = rows.where("kind = 'base'")
    a, b, active = F.col("a"), F.col("b"), F.col("i").isNotNull()
    compared = rows.withColumn("r", array_pearson(a, b))
    compared = compared.select("*", *[x.alias(k) for k, x in compare_frame(a, b, F.col("r"), F.col("ref_rms"), F.col("deg_rms")).items()])
    level = F.abs(db(F.col("deg_rms") + 1e-9) - db(F.col("ref_rms") + 1e-9))
    once = ("peak", "floor", "delay_ms", "drift_ppm", "clipped", "seconds", "bandwidth", "error")
    compared = staged(compared.withColumn("level", level).drop("a", "b", "r", "kind", "x", "y", "z"), "compared")
    sums = compared.groupBy("pair_id").agg(
        *[F.first(c).alias(c) for c in once], F.count("i").alias("frames"), *[F.avg(c).alias(c) for c in ("missing", "added", "similarity", "level")],
        F.avg("coloration").alias("color"), F.avg("discontinuity").alias("gaps"), F.avg((F.col("discontinuity") > 0.45).cast("int")).alias("bad_section"),
    )
    worst = order_statistics(compared.where(active), ["pair_id"], "discontinuity", {"worst": 0.9})
    sums = sums.join(worst, "pair_id", "left")
    dims = dimensions(F.col("color"), F.col("added"), F.col("gaps"), F.col("worst"), db(F.col("peak") + 1e-9) - F.col("floor"), F.col("level"))
    sums = sums.withColumns({f"dim_{k}": x for k, x in dims.items()})
    sums = sums.withColumns({k: (5 - F.col(f"dim_{k}")) / 4 for k in dims} | {"clipping": clamp(F.col("clipped") * 40)})
    seconds = F.col("frames") * (HOP / RATE)
    confidence = clamp(0.25 + 0.45 * clamp(seconds / 3) + 0.30 * clamp(F.col("similarity")))
    ok, silent = F.col("error").isNull(), F.col("frames") == 0
    # A pair without speech is told by fixed values, one with an error by none.
    heard = lambda x, otherwise: F.when(ok, F.when(silent, F.lit(otherwise)).otherwise(x))
    told = sums.select(
        "pair_id", "error", "bandwidth", r6(heard(base_mos(), 1.0)).alias("mos"), r6(heard(confidence, 0.0)).alias("confidence"),
        F.when(ok, F.col("delay_ms")).alias("delay_ms"), r6(F.when(ok, F.col("drift_ppm"))).alias("drift_ppm"), r6(F.when(ok, seconds)).alias("active_seconds"), *[r6(heard(F.col(f"dim_{k}"), 1.0)).alias(f"dim_{k}") for k in dims],
        *[r6(heard(F.col(c), 0.0)).alias(n) for c, n in (("missing", "missing"), ("added", "added"), ("bad_section", "bad_section"), ("clipped", "clipping_ratio"))],
        F.when((F.col("clipped") > 0.0005) & ~silent, F.struct(F.lit("clipping").alias("type"), F.lit(0.0).alias("start_ms"), (F.col("seconds") * 1000).alias("duration_ms"), r6(clamp(F.col("clipped") * 80)).alias("severity"))).alias("clip"),
    )
    # Dropouts: runs over active frames, which need not touch each other.
    order = W.partitionBy("pair_id").orderBy("place")
    numbered = compared.where(active).select("pair_id", F.col("i").alias("place"), F.col("discontinuity").alias("q"))
    numbered = numbered.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    drops = events(numbered.select("pair_id", "i", "q"), ["pair_id"]).join(numbered.select("pair_id", F.col("i").alias("first"), "place"), ["pair_id", "first"])
    ms = 1000 * HOP / RATE
    drops = drops.select("pair_id", F.struct(F.lit("dropout").alias("type"), (F.col("place") * ms).alias("start_ms"), (F.col("frames") * ms + 1000 * FRAME / RATE).alias("duration_ms"), r6(F.col("severity")).alias("severity")).alias("e"))
    heard = drops.groupBy("pair_id").agg(F.array_sort(F.collect_list("e")).alias("drops"))
    none = F.array().cast("array<struct<type: string, start_ms: double, duration_ms: double, severity: double>>")
    joined = told.join(heard, "pair_id", "left")
    return joined.withColumn("events", F.concat(F.coalesce("drops", none), F.when(F.col("clip").isNotNull(), F.array("clip")).otherwise(none))).drop("drops", "clip")


def analyse_advanced(pairs: DataFrame, weights: dict[str, float] = FINAL) -> DataFrame:
    """analyse()'s columns and the diagnostics of the advanced analysis; mos is the final estimate, base_mos the base one,
    and the confidence is blended with the share of resolutions that have frames. With an error, nothing but the
    error; a pair without speech still has diagnostics."""
    rows = staged(frames(pairs), "frames")
    base = base_results(rows).withColumnsRenamed({"mos": "base_mos", "confidence": "base_confidence"})
    found = base.join(diagnostics(rows), "pair_id", "left")
    lacks = {
        "multi_resolution": 1 - F.col("multi_resolution_similarity"), "temporal": 1 - F.col("temporal_envelope_similarity"), "modulation": 1 - F.col("modulation_similarity"),
        "asymmetry": F.col("asymmetric_disturbance"), "tilt": F.col("spectral_tilt_error"), "level": clamp(F.col("active_level_delta_db") / 18), "bad_interval": F.col("bad_interval_severity"),
        "echo": F.col("echo_score"), "choppiness": F.col("choppiness_score"), "residual": F.col("residual_intrusion"),
    }
    found = found.withColumns(lacks)
    confidence = clamp(0.65 * F.col("base_confidence") + 0.35 * clamp(F.col("resolutions") / 3))
    return found.withColumns({"mos": r6(final_mos(F.col("base_mos"), weights)), "confidence": r6(confidence)}).drop(*lacks)


def feature_rows(results: DataFrame, experts: DataFrame) -> DataFrame:
    """The training row of each analysed pair: pair_id and the hinge model's features, out of analyse_advanced() and the
    experts' scores (pair_id, visqol_speech_mos, visqol_audio_mos, clipped to 1 to 5); without scores, null features."""
    named = results.withColumnsRenamed({"missing": "missing_disturbance", "added": "added_disturbance", "bad_section": "bad_section_fraction"})
    named = named.join(experts.select("pair_id", *[clamp(F.col(c), 1, 5).alias(c) for c in ("visqol_speech_mos", "visqol_audio_mos")]), "pair_id", "left")
    return named.where("error is null").select("pair_id", *hybrid_features())


#: The fields of a result's advanced object, in order.
DIAGNOSTICS = [
    "erb_similarity", "multi_resolution_similarity", "temporal_envelope_similarity", "modulation_similarity", "asymmetric_disturbance", "spectral_tilt_error",
    "active_level_delta_db", "bad_interval_severity", "echo_score", "choppiness_score", "residual_intrusion",
]


def result_json() -> Column:
    """A row of analyse_advanced() as a result document: the base fields, dimensions and events, and an advanced object."""
    dims = F.struct(*[F.col(f"dim_{k}").alias(k) for k in ("coloration", "noisiness", "discontinuity", "loudness")])
    plain = ["mos", "confidence", "bandwidth", "delay_ms"]
    named = {"clock_drift_ppm": "drift_ppm", "active_speech_seconds": "active_seconds", "clipping_ratio": "clipping_ratio", "missing_disturbance": "missing", "added_disturbance": "added", "bad_section_fraction": "bad_section"}
    fields = [*map(F.col, plain), *[F.col(c).alias(n) for n, c in named.items()], dims.alias("dimensions"), F.col("events"), F.col("base_mos")]
    return F.to_json(F.struct(*fields, F.lit(False).alias("hybrid_applied"), F.struct(*[r6(F.col(c)).alias(c) for c in DIAGNOSTICS]).alias("advanced")))


def speech_like(rate: int = 16_000, seconds: float = 3.0) -> np.ndarray:
    t = np.arange(int(rate * seconds)) / rate
    parts = ((0.28, 180), (0.16, 720), (0.08, 2100), (0.04, 5200))
    return (0.45 + 0.45 * np.sin(2 * np.pi * 2.7 * t)) * (0.65 + 0.35 * np.sin(2 * np.pi * 0.83 * t * t)) * sum(g * np.sin(2 * np.pi * f * t) for g, f in parts)


def degrade(x: np.ndarray, op: str, arg: float, rate: int = 16_000, more: float | None = None) -> np.ndarray:
    """delay (ms), dropout (ms, from a third or from `more` seconds on), repeated (a number of 80 ms dropouts), noise (dB
    below; seed `more`), clip (gain), threshold, gain (dB), lowpass (share of the step), pole (Hz, three in a row), drift
    (millionths), stretch (percent)."""
    if op == "delay":
        return np.concatenate([np.zeros(int(rate * arg / 1000)), x])
    if op == "dropout":
        out, a = x.copy(), len(x) // 3 if more is None else int(more * rate)
        out[a : a + int(rate * arg / 1000)] = 0
        return out
    if op == "repeated":
        for i in range(int(arg)):
            x = degrade(x, "dropout", 80, rate, 0.9 + 0.8 * i)
        return x
    if op == "noise":
        noisy = x + np.random.default_rng(int(more or 1)).normal(0, np.sqrt((x * x).mean()) * 10 ** (-arg / 20), len(x))
        return noisy if more is None else np.clip(noisy, -1, 1)
    if op == "clip":
        return np.clip(x * arg, -1, 1)
    if op == "threshold":
        return np.clip(x, -arg, arg)
    if op == "gain":
        return x * 10 ** (arg / 20)
    if op == "lowpass":
        out, y = np.empty_like(x), 0.0
        for i, v in enumerate(x):
            y += arg * (v - y)
            out[i] = y
        return out
    if op == "pole":
        keep = np.exp(-2 * np.pi * arg / rate)
        size = 1 << (2 * len(x)).bit_length()
        response = (1 - keep) / (1 - keep * np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size))
        return np.fft.irfft(np.fft.rfft(x, size) * response**3, size)[: len(x)]
    if op in ("drift", "stretch"):
        factor = 1 + arg * (1e-6 if op == "drift" else 0.01)
        place = np.arange(int(round(len(x) * factor))) / factor
        return np.interp(place, np.arange(len(x)), x)
    return x


def scenarios(fuzz: int = 120) -> list[tuple[str, float, int, list[tuple[str, float, float | None]]]]:
    """(family, level, rate of both signals, steps): one damage each at rising levels, clean material at other rates, three
    mixtures, and random compositions from a fixed seed."""
    # The levels of each family.
    single = {
        "delay": ("delay", [25, 50, 100, 200, 400, 800, 1200], lambda v: v),
        "dropout": ("dropout", [10, 20, 40, 80, 160, 320, 640, 1000], lambda v: v),
        "dropout_count": ("repeated", [1, 2, 3, 4, 5], lambda v: v),
        "noise": ("noise", [40, 30, 20, 15, 10, 5, 0], lambda v: 50 - v),
        "lowpass": ("pole", [18000, 14000, 10000, 7000, 4000, 3400, 2200], lambda v: 20000 - v),
        "clipping": ("threshold", [0.95, 0.70, 0.50, 0.35, 0.25, 0.15, 0.08], lambda v: 1 - v),
        "attenuation": ("gain", [-1, -3, -6, -9, -12, -18, -24], abs),
        "clock_drift": ("drift", [25, 50, 100, 250, 500, 1000, 2000], lambda v: v),
        "time_scale": ("stretch", [0.25, 0.5, 1, 2, 4, 8], lambda v: v),
    }
    mixed = [
        [("dropout", 20.0, 2.15), ("noise", 30.0, 42.0)],
        [("pole", 7000.0, None), ("dropout", 80.0, 2.15), ("noise", 18.0, 42.0)],
        [("gain", -8.0, None), ("pole", 3400.0, None), ("dropout", 320.0, 2.15), ("noise", 8.0, 42.0)],
    ]
    out = [("clean", 0.0, RATE, [])]
    for family, (op, values, level) in single.items():
        more = {"dropout": 2.15, "noise": 42.0}.get(family)
        out += [(family, float(level(v)), RATE, [(op, float(v), more)]) for v in values]
    out += [("sample_rate", float(rate), rate, []) for rate in (8000, 16000, 24000, 32000, 44100, 48000)]
    out += [("mixed", float(i), RATE, steps) for i, steps in enumerate(mixed, 1)]
    random = np.random.default_rng(123456)
    # How often a step occurs in a composition, and its range.
    chances = [(0.75, "noise", 0, 45), (0.65, "gain", -30, 8), (0.60, "dropout", 1, 1100), (0.45, "threshold", 0.05, 0.95), (0.40, "pole", 1800, 18000), (0.25, "delay", 0, 1400)]
    for i in range(fuzz):
        steps = []
        for chance, op, low, high in chances:
            if random.random() < chance:
                steps.append((op, float(random.uniform(low, high)), {"noise": 1000.0 + i, "dropout": float(random.uniform(0.3, 4.8))}.get(op)))
        out.append(("fuzz", float(i), RATE, steps))
    return out
