"""The advanced half of an analysis: what a pair tells at three resolutions, in its modulation, echo, holes and freezes.

One pass over the recordings emits a long table: a row for each frame and resolution (ERB loudness of both sides), each
10 ms of envelope, each 5 ms and 20 ms block that is active, and each echo lag. All that follows is a query over those
rows: similarities of frames as columns, deciles as order statistics over rows, sums by pair; no array of a pair's
frames is ever built."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.functions.columns import bound, clamp, cosine, dot, pearson, total
from voxlattice.operators.order_statistics import order_statistics
from voxlattice.operators.signal import asymmetry

# Frame and hop of the three resolutions in ms, bands, and the gate's share of the loudest frame.
RESOLUTIONS, ERB_BANDS, GATE = {"r20": (20, 10), "r80": (80, 40), "r200": (200, 100)}, 32, 0.035
# Echo lags in ms, and the share of the loudest block from which blocks are active.
LAGS, ACTIVE = range(20, 451, 5), 0.04
PARTS = "kind string, i int, a array<double>, b array<double>, x double, y double, z double"


#: What is one for several rows, and their columns: 1 or 2 dimensions, or lists.
Piece = tuple[dict, dict]
#: A batch of rows goes out when so many have come together.
TOGETHER = 4096
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray) and values.ndim == 2:
        rows, width = values.shape
        return pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), np.ascontiguousarray(values).ravel())
    return pa.array(values, kind, from_pandas=True)


def _batch(pieces: list[Piece], schema: pa.Schema) -> pa.RecordBatch:
    lengths = [len(next(iter(columns.values()))) for _, columns in pieces]

    def column(field: pa.Field, own: dict, columns: dict, n: int) -> pa.Array:
        if field.name in columns:
            return _arrow(columns[field.name], field.type)
        value = own.get(field.name)
        return pa.nulls(n, field.type) if value is None else pa.repeat(pa.scalar(value, field.type), n)

    return pa.RecordBatch.from_arrays([pa.concat_arrays([column(f, *piece, n) for piece, n in zip(pieces, lengths, strict=True)]) for f in schema], schema=schema)


def batched(pieces: Iterable[Iterable[Piece]], ddl: str) -> Iterator[pa.RecordBatch]:
    """Pieces as Arrow batches of `ddl`'s columns; what a piece does not have is null."""
    fields = [c.split() for c in ddl.split(", ")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    held, rows = [], 0
    for some in pieces:
        for piece in some:
            held.append(piece)
            rows += len(next(iter(piece[1].values())))
            if rows >= TOGETHER:
                yield _batch(held, schema)
                held, rows = [], 0
    if held:
        yield _batch(held, schema)


def floats(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64)


def resample_linear(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(x):
        return x.astype(np.float32).astype(np.float64)
    ratio = to / rate
    place = np.arange(int(np.floor(len(x) * ratio + 0.5))) / ratio
    j = np.minimum(place.astype(np.int64), len(x) - 1)
    share = place - j
    return ((1 - share) * x[j] + share * x[np.minimum(j + 1, len(x) - 1)]).astype(np.float32).astype(np.float64)


@lru_cache
def erb_bins(rate: int, size: int) -> list[tuple[int, int]]:
    """Bins of each band: bands of equal width on the ERB scale, at least one bin in each."""
    to_erb, to_hertz = lambda f: 21.4 * math.log10(1 + 0.00437 * f), lambda e: (10 ** (e / 21.4) - 1) / 0.00437
    low, high, out = to_erb(50.0), to_erb(min(20000.0, rate * 0.48)), []
    for band in range(ERB_BANDS):
        lo, hi = (to_hertz(low + (high - low) * k / ERB_BANDS) for k in (band, band + 1))
        k0 = min(size // 2, int(lo * size / rate))
        out.append((k0, max(min(size // 2 + 1, math.ceil(hi * size / rate)), k0 + 1)))
    return out


def _loudness(frames: np.ndarray, rate: int) -> np.ndarray:
    size = 1 << max(0, frames.shape[1] - 1).bit_length()
    window = np.hanning(frames.shape[1]) if frames.shape[1] > 1 else np.zeros(1)
    power = np.abs(np.fft.rfft(frames * window, size)) ** 2
    return np.stack([(power[:, a:b].sum(1) / (b - a) + 1e-15) ** 0.23 for a, b in erb_bins(rate, size)], 1)


def _rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).mean(-1)) if x.shape[-1] else np.zeros(x.shape[:-1])


def _whole(x: np.ndarray, size: int) -> np.ndarray:
    """Whole blocks of `size`, one a row."""
    return x[: len(x) // size * size].reshape(-1, size)


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 16:
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    aa, bb = (a * a).sum(), (b * b).sum()
    return float(np.clip((a * b).sum() / np.sqrt(aa * bb), -1, 1)) if aa >= 1e-12 and bb >= 1e-12 else 0.0


def part_rows(r: np.ndarray, d: np.ndarray, rate: int, delay: int) -> pd.DataFrame:
    """The rows of one pair of equal rate; delay: samples by which d is behind r."""
    return _batch(part_pieces(r, d, rate, delay), pa.schema([(c, _ARROW[k]) for c, k in map(str.split, PARTS.split(", "))])).to_pandas()


def part_pieces(r: np.ndarray, d: np.ndarray, rate: int, delay: int) -> list[Piece]:
    """part_rows() as pieces of one kind each."""
    out: list[Piece] = []

    def add(kind: str, **columns) -> None:
        out.append(({"kind": kind}, columns))

    for kind, (long_, step) in RESOLUTIONS.items():
        frame, hop = long_ * rate // 1000, step * rate // 1000
        starts = np.arange(0, len(r) - frame + 1, hop)
        cut = np.arange(frame)
        level = [_rms(r[starts[k : k + 512, None] + cut]) for k in range(0, len(starts), 512)]
        level = np.concatenate(level) if level else np.zeros(0)
        there = starts + delay
        use = starts[(there >= 0) & (there + frame <= len(d)) & (level >= level.max(initial=0.0) * GATE)]
        for k in range(0, len(use), 128):
            at = use[k : k + 128, None]
            add(kind, i=(at[:, 0] // hop).astype(np.int32), a=_loudness(r[at + cut], rate), b=_loudness(d[at + delay + cut], rate))

    hop = rate // 100
    n = len(r) // hop
    at = np.arange(n) * hop + delay
    fits = (at >= 0) & (at + hop <= len(d))
    copy = np.zeros(n)
    copy[fits] = _rms(d[at[fits, None] + np.arange(hop)])
    if n:
        add("env", i=np.arange(n, dtype=np.int32), x=_rms(_whole(r, hop)), y=copy, z=np.full(n, float(n)))

    tail = d[delay if delay > 0 else 0 :]
    level = abs(20 * math.log10((float(_rms(tail)) + 1e-9) / (float(_rms(r)) + 1e-9)))
    ar, ad = r[max(0, -delay) :], d[max(0, delay) :]
    n = min(len(ar), len(ad))
    ar, ad, ratio = ar[:n], ad[:n], None
    if n >= rate // 2 and n:
        rr, dd = (ar * ar).sum(), (ad * ad).sum()
        residual = (ad - ((ar * ad).sum() / rr if rr > 1e-12 else 0.0) * ar).astype(np.float32).astype(np.float64)
        ratio = math.sqrt((residual * residual).sum() / (dd + 1e-12))
        block = max(1, rate // 1000)
        blocks = lambda x: np.add.reduceat(x, np.arange(0, n, block)) / np.minimum(block, n - np.arange(0, n, block))
        one, two = blocks(ar), blocks(residual)
        m = len(one)
        told = []
        for lag in (lag for lag in LAGS if m > lag + 16):
            ends = [(m - lag) * q // 4 for q in range(5)]
            quarters = [abs(_correlation(one[a:b], two[a + lag : b + lag])) for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a + 20]
            told.append((lag, abs(_correlation(one[: m - lag], two[lag:])), quarters))
        if told:
            add("echo", i=np.array([t[0] for t in told], np.int32), x=[t[1] for t in told], a=[t[2] for t in told])
        micro, longer = max(1, rate * 5 // 1000), max(1, rate * 20 // 1000)
        er, ed = _rms(_whole(ar, micro)), _rms(_whole(ad, micro))
        least = (er.max() if len(er) else 0.0) * ACTIVE
        heard = np.flatnonzero(er >= least)
        add("micro", i=heard.astype(np.int32), x=er[heard], y=ed[heard])
        r1, d1 = _whole(ar, longer), _whole(ad, longer)
        if len(r1) > 1:
            moved = lambda x: np.sqrt(((x[1:] - x[:-1]) ** 2).sum(1) / ((x[1:] ** 2).sum(1) + (x[:-1] ** 2).sum(1) + 1e-12))
            loud = np.maximum(_rms(r1[1:]), _rms(r1[:-1])) >= least
            add("freeze", i=np.flatnonzero(loud).astype(np.int32), x=moved(r1)[loud], y=moved(d1)[loud])
    add("pair", x=[ratio], y=[level])
    return out


def _unit(a: Column) -> Column:
    return bound(total(a), lambda s: F.transform(a, lambda x: x / (s + 1e-12)))


def _slope(a: Column) -> Column:
    """Least-squares slope of ln(a + 1e-12) on ln(1 + i) over the bands, whose places are fixed."""
    x = np.log1p(np.arange(ERB_BANDS))
    x = x - x.mean()
    return dot(F.array(*map(F.lit, (x / (x * x).sum()).tolist())), F.transform(a, lambda v: F.ln(v + 1e-12)))


def frame_measures(rows: DataFrame) -> DataFrame:
    """pair_id, kind, similarity, asymmetry, tilt of each frame at each resolution."""
    frames = rows.where(F.col("kind").isin(*RESOLUTIONS)).select("pair_id", "kind", _unit(F.col("a")).alias("a"), _unit(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return frames.select("pair_id", "kind", cosine(a, b).alias("similarity"), asymmetry(a, b).alias("asymmetry"), clamp(F.abs(_slope(a) - _slope(b)) / 2).alias("tilt"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """pair_id and its diagnostics: resolutions (how many have frames), erb_similarity, multi_resolution_similarity,
    temporal_envelope_similarity, modulation_similarity, asymmetric_disturbance, spectral_tilt_error,
    active_level_delta_db, bad_interval_severity, echo_score, choppiness_score, residual_intrusion. rows: a staged table
    of part_rows() with a pair_id; a pair without any has no diagnostics."""
    ratio = F.col("y") / (F.col("x") + 1e-9)
    frames = frame_measures(rows)
    micro = rows.where("kind = 'micro'").select("pair_id", "i", ratio.alias("ratio"))
    measured = frames.select("pair_id", "kind", F.col("similarity").alias("v")).unionByName(micro.select("pair_id", F.lit("micro").alias("kind"), F.col("ratio").alias("v")))
    places = order_statistics(measured, ["pair_id", "kind"], "v", {"p10": 0.1, "p50": 0.5})

    low = places.where("kind != 'micro'").select("pair_id", "kind", (1 - F.col("p10")).alias("bad"))
    per = frames.groupBy("pair_id", "kind").agg(*[F.avg(c).alias(c) for c in ("similarity", "asymmetry", "tilt")]).join(low, ["pair_id", "kind"])
    rolled = per.groupBy("pair_id").agg(
        F.count("*").alias("resolutions"), F.max(F.when(F.col("kind") == "r20", F.col("similarity"))).alias("erb_similarity"), F.avg("similarity").alias("multi_resolution_similarity"),
        F.avg("asymmetry").alias("asymmetric_disturbance"), F.avg("tilt").alias("spectral_tilt_error"), F.max("bad").alias("bad_interval_severity"),
    )

    # Ratios over their median, of pairs with eight active blocks or more.
    enough = micro.groupBy("pair_id").agg(F.count("*").alias("m")).where("m >= 8")
    median = places.where("kind = 'micro'").select("pair_id", F.greatest(F.lit(1e-6), "p50").alias("median"))
    raw = micro.join(enough, "pair_id").join(median, "pair_id").select("pair_id", "i", (F.col("ratio") / F.col("median")).alias("raw"))
    raw = raw.withColumn("q", clamp(F.col("raw"), 0, 2.5))
    before = F.coalesce(F.lag("q").over(W.partitionBy("pair_id").orderBy("i")), F.col("raw"))
    steps = raw.select("pair_id", clamp((0.65 - F.col("q")) / 0.65).alias("hole"), clamp(F.abs(F.col("q") - before) / 1.2).alias("v"))
    holes = steps.groupBy("pair_id").agg(F.avg("hole").alias("hole"))
    freezes = rows.where("kind = 'freeze' and x > 0.08").select("pair_id", F.lit("freeze").alias("kind"), clamp((0.55 - ratio) / 0.55).alias("v"))
    upper = order_statistics(freezes.unionByName(steps.select("pair_id", F.lit("step").alias("kind"), "v")), ["pair_id", "kind"], "v", {"p90": 0.9})
    own = lambda name: F.max(F.when(F.col("kind") == name, F.col("p90"))).alias(name)
    upper = upper.groupBy("pair_id").agg(own("freeze"), own("step"))

    # What adds up, in one pass: envelopes, their first 16 modulations, the best echo (of equal ones the shortest lag).
    env = lambda c: F.when(F.col("kind") == "env", c)
    angle = lambda k: 2 * math.pi * k * F.col("i") / F.col("z")
    waves = [F.sum(env(F.col(c) * f(angle(k)))).alias(f"{c}{k}{name}") for c in ("x", "y") for k in range(1, 17) for name, f in (("re", F.cos), ("im", F.sin))]
    x, y = env(F.col("x")), env(F.col("y"))
    echo = F.max(F.when(F.col("kind") == "echo", F.struct("x", (-F.col("i")).alias("lag"), "a"))).alias("echo")
    pair = lambda c: F.max(F.when(F.col("kind") == "pair", F.col(c)))
    summed = rows.where(F.col("kind").isin("env", "echo", "pair")).groupBy("pair_id").agg(
        F.count(x).alias("n"), pearson(x, y).alias("r"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), *waves, echo, pair("x").alias("residual"), pair("y").alias("active_level_delta_db")
    )
    size = lambda c: F.array(*[F.sqrt(F.col(f"{c}{k}re") ** 2 + F.col(f"{c}{k}im") ** 2) for k in range(1, 17)])
    a, b = size("x"), size("y")
    waving = F.when((F.col("n") >= 16) & (dot(a, a) > 1e-12) & (dot(b, b) > 1e-12), cosine(a, b)).otherwise(0.0)
    varies = (F.col("n") > 1) & (F.col("vx") * F.col("n") > 1e-12) & (F.col("vy") * F.col("n") > 1e-12)
    together = F.when(varies, clamp(F.col("r"), -1, 1)).otherwise(0.0)
    steady = F.coalesce(F.array_min("echo.a"), F.lit(0.0))  # the lower quartile of up to four values is the least
    joined = summed.join(rolled, "pair_id", "left").join(holes, "pair_id", "left").join(upper, "pair_id", "left")
    heard = F.coalesce(clamp(F.sqrt(F.greatest(F.lit(0.0), F.col("echo.x") * steady)) * clamp(F.col("residual") * 1.8)), F.lit(0.0))
    zero = lambda c, other=0.0: F.coalesce(F.col(c), F.lit(other))
    out = joined.withColumn("echo_score", heard)
    return out.select(
        "pair_id", zero("resolutions", 0).alias("resolutions"), zero("erb_similarity").alias("erb_similarity"), zero("multi_resolution_similarity").alias("multi_resolution_similarity"),
        clamp((together + 1) / 2).alias("temporal_envelope_similarity"), waving.alias("modulation_similarity"), zero("asymmetric_disturbance", 1.0).alias("asymmetric_disturbance"),
        zero("spectral_tilt_error", 1.0).alias("spectral_tilt_error"), "active_level_delta_db", zero("bad_interval_severity").alias("bad_interval_severity"), "echo_score",
        clamp(0.46 * zero("hole") + 0.18 * zero("step") + 0.36 * zero("freeze")).alias("choppiness_score"), F.coalesce(clamp(F.col("residual") - 0.65 * F.col("echo_score")), F.lit(0.0)).alias("residual_intrusion"),
    )


def parts(pairs: DataFrame, rate: int) -> DataFrame:
    """pairs: pair_id, ref and deg (array<double>, or binary: unsigned samples of 8 bits), delay (samples) -> part rows with
    the pair_id; pairs with an empty side have none."""
    kind = pairs.schema["pair_id"].dataType.simpleString()
    schema = f"pair_id {kind}, {PARTS}"
    samples = lambda x: (np.frombuffer(x.as_buffer(), np.uint8) - 128.0) / 128 if isinstance(x, pa.BinaryScalar) else floats(x.values)

    def told(batch: pa.RecordBatch) -> Iterator[Piece]:
        for pair, ref, deg, delay in zip(batch["pair_id"].to_pylist(), batch["ref"], batch["deg"], batch["delay"].to_pylist(), strict=True):
            if ref.is_valid and deg.is_valid:
                r, d = samples(ref), samples(deg)
                if len(r) and len(d):
                    yield from (({**own, "pair_id": pair}, columns) for own, columns in part_pieces(r, d, rate, int(delay)))

    return pairs.select("pair_id", "ref", "deg", "delay").mapInArrow(lambda batches: batched(map(told, batches), schema), schema)
