"""Signal operators on arrays and frame tables: spectra, bands, envelopes, frames, lags. Arrays are a row's own and of
bounded length (a recording's bands or hours); what grows with the corpus is the number of rows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.functions.columns import bound, centred, clamp, cosine, db, dot, slope, total


def unit_sum(a: Column) -> Column:
    return bound(total(a), lambda s: F.transform(a, lambda x: x / (s + 1e-12)))


def asymmetry(a: Column, b: Column) -> Column:
    """From unit-sum spectra: what is missing counts three quarters, what is added five quarters."""
    missing = total(F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), x - y)))
    added = total(F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), y - x)))
    return clamp(0.75 * missing + 1.25 * added)


def tilt(a: Column, b: Column) -> Column:
    return clamp(F.abs(slope(a) - slope(b)) / 2)


def blocks(a: Column, width: int) -> Column:
    """Means of consecutive blocks of `width`, the last one maybe shorter."""
    n = F.ceil(F.size(a) / width).cast("int")
    part = lambda i: F.slice(a, i * width + 1, F.lit(width))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(part(i)) / F.size(part(i)))


def log_band_energies(power: Column, bins: int, rate: float, bands: int, low: float = 50.0, high: float = 20000.0) -> Column:
    """dB of mean power in log-spaced bands, at least one bin in each."""
    top, size, out = min(high, rate / 2 * 0.98), (bins - 1) * 2, []
    for band in range(bands):
        lo, hi = (low * (top / low) ** (k / bands) for k in (band, band + 1))
        k0 = min(int(lo * size / rate), bins - 1)
        k1 = min(max(math.ceil(hi * size / rate), k0 + 1), bins)
        out.append(10 * F.log10(total(F.slice(power, k0 + 1, k1 - k0)) / (k1 - k0) + 1e-14))
    return F.array(*out)


def erb_loudness(power: Column, bins: int, rate: float, bands: int = 32) -> Column:
    """Compressed mean power in bands of equal width on the ERB scale, at least one bin in each."""
    to_erb, to_hertz = lambda f: 21.4 * math.log10(1 + 0.00437 * f), lambda e: (10 ** (e / 21.4) - 1) / 0.00437
    low, high, size, out = to_erb(50.0), to_erb(min(20000.0, rate * 0.48)), (bins - 1) * 2, []
    for band in range(bands):
        lo, hi = (to_hertz(low + (high - low) * k / bands) for k in (band, band + 1))
        k0 = min(int(lo * size / rate), bins - 1)
        k1 = max(min(math.ceil(hi * size / rate), bins), k0 + 1)
        out.append(F.pow(total(F.slice(power, k0 + 1, k1 - k0)) / (k1 - k0) + 1e-15, F.lit(0.23)))
    return F.array(*out)


def bandwidth(power: Column, bins: int, rate: float) -> Column:
    """NB, WB, SWB or FB by the share of power above 3.4, 7 and 14 kHz."""
    size, top = (bins - 1) * 2, min(20000.0, rate * 0.49)

    def band(low: float) -> Column:
        a, b = min(bins - 1, int(low * size / rate)), min(bins, math.ceil(top * size / rate))
        return total(F.slice(power, a + 1, max(0, b - a)))

    all_ = band(80) + 1e-12
    return F.when(band(3400) / all_ < 0.003, "NB").when(band(7000) / all_ < 0.003, "WB").when(band(14000) / all_ < 0.002, "SWB").otherwise("FB")


def compare_frame(a: Column, b: Column, pearson: Column, rms_a: Column, rms_b: Column) -> dict[str, Column]:
    """coloration, missing, added, similarity, discontinuity of two frames: their band vectors in dB, and their RMS, which
    gives the level penalty and the holes."""
    n = F.size(a)
    color = total(F.zip_with(centred(a), centred(b), lambda x, y: F.abs(y - x)))
    missing = total(F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), x - y - 1.5)))
    added = total(F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), y - x - 1.5)))
    level = clamp(F.abs(db(rms_b + 1e-9) - db(rms_a + 1e-9)) / 24)
    similarity = clamp(0.75 * (pearson + 1) / 2 + 0.25 * (1 - level))
    ratio = rms_b / (rms_a + 1e-9)
    hole = F.when(ratio < 0.22, clamp((0.22 - ratio) / 0.22)).otherwise(0.0)
    return {
        "coloration": clamp(color / (n * 18.0)),
        "missing": clamp(missing / (n * 22.0)),
        "added": clamp(added / (n * 22.0)),
        "similarity": similarity,
        "discontinuity": clamp(F.greatest(hole, (0.45 - similarity) * 1.8)),
    }


def dimensions(color: Column, added: Column, gaps: Column, worst: Column, snr: Column, level: Column) -> dict[str, Column]:
    """coloration, noisiness, discontinuity and loudness from 1 to 5, of means over active frames (color, added, gaps: the
    discontinuity, level: the difference in dB), the gaps' worst decile, and the distance of speech and noise floor in dB."""
    lacks = {"coloration": color, "noisiness": clamp((28 - snr) / 28) * 0.65 + added * 0.35, "discontinuity": clamp(0.55 * gaps + 0.45 * worst), "loudness": clamp(level / 18)}
    return {name: clamp(5 - 4 * x, 1, 5) for name, x in lacks.items()}


def dft_power(samples: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """keys, k, power: of series rows (keys, i from 0, x, n), Hann-windowed, bins 1..bins as cycles a series."""
    w = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("i") / F.greatest(F.lit(1), F.col("n") - 1))
    x, angle = F.col("x") * w, 2 * math.pi * F.col("k") * F.col("i") / F.col("n")
    rows = samples.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    parts = rows.groupBy(*keys, "k").agg(F.sum(x * F.cos(angle)).alias("re"), F.sum(x * F.sin(angle)).alias("im"))
    return parts.select(*keys, "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im") + 1e-14).alias("power"))


#: Places of a series that one group of lag_correlation() holds.
STRETCH = 4096


def lag_correlation(a: DataFrame, b: DataFrame, keys: list[str], radius: int, least: int = 8, part: str | None = None) -> DataFrame:
    """keys (and part, a column of a alone), lag, c: the uncentred correlation of a.i with b.i + lag over the overlap.
    Series are cut into stretches of places; a row of b goes to each stretch that it can meet. A row is sent once or twice,
    whatever the radius, nothing is broadcast, and a group is one stretch, however long its series."""
    stretch = lambda i: F.floor(i / STRETCH).cast("long")
    row = lambda x, p: F.struct(x.cast("long").alias("i"), F.col("x").cast("double").alias("x"), p.cast("long").alias("part"))
    i, none = F.col("i"), F.lit(0)
    left = a.where("i is not null").select(*keys, stretch(i).alias("stretch"), row(i, F.col(part) if part else none).alias("left"), F.lit(None).alias("right"))
    each = F.explode(F.sequence(stretch(i - radius), stretch(i + radius))).alias("stretch")
    right = b.where("i is not null").select(*keys, each, F.lit(None).alias("left"), row(i, none).alias("right"))
    met = left.unionByName(right).groupBy(*keys, "stretch").agg(F.collect_list("left").alias("left"), F.collect_list("right").alias("right"))
    lags = np.arange(-radius, radius + 1)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch["stretch"].to_numpy() * STRETCH
            sides = []
            for side in ("left", "right"):
                ends, rows = batch[side].offsets.to_numpy(), batch[side].values
                x = rows.field("x").to_numpy(zero_copy_only=False)
                sides.append((ends, rows.field("i").to_numpy(), np.where(np.isnan(x), 0.0, x), rows.field("part").fill_null(-1).to_numpy()))
            groups, parts, found = [], [], []
            for g in range(len(batch)):
                (ia, xa, pa_), (ib, xb, _) = ([v[ends[g] : ends[g + 1]] for v in rest] for ends, *rest in sides)
                if not len(ia) or not len(ib):
                    continue
                # Counts, sums and squares by place; b begins `radius` before the stretch.
                laid = lambda at, size, x: [np.bincount(at, w, size) for w in (np.ones(len(x)), x, x * x)]
                y = [sliding_window_view(v, STRETCH) for v in laid(ib - begin[g] + radius, STRETCH + 2 * radius, xb)]
                for p in np.unique(pa_):
                    at = ia[pa_ == p] - begin[g]
                    lo, hi = at.min(), at.max() + 1
                    x = [v[lo:hi] for v in laid(at, STRETCH, xa[pa_ == p])]
                    sums = [np.einsum("ln,n->l", y[k][:, lo:hi], x[m]) for k, m in ((0, 0), (1, 1), (0, 2), (2, 0))]
                    groups.append(g)
                    parts.append(p)
                    found.append(np.stack(sums))
            if groups:
                each = np.repeat(groups, len(lags))
                of = [batch[k].take(pa.array(each)) for k in keys]
                sums = np.concatenate(found, 1)
                columns = [*of, pa.array(np.repeat(parts, len(lags)), pa.int64()), pa.array(np.tile(lags, len(groups)), pa.int32()), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "_part", "lag", "n", "xy", "xx", "yy"])

    kinds = ", ".join(f"`{k}` {a.schema[k].dataType.simpleString()}" for k in keys)
    sums = met.mapInArrow(told, f"{kinds}, _part long, lag int, n double, xy double, xx double, yy double").where("n > 0")
    own = [F.col("_part").alias(part)] if part else []
    sums = sums.groupBy(*keys, "_part", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "xx", "yy")])
    c = F.when((F.col("n") < least) | (F.col("xx") < 1e-12) | (F.col("yy") < 1e-12), -1.0).otherwise(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))))
    return sums.select(*keys, *own, "lag", F.round(c, 9).alias("c"))


def best_lag(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lag, c: the largest correlation, of equal ones the lowest lag."""
    best = F.max(F.struct("c", (-F.col("lag")).alias("m"))).alias("best")
    return correlations.groupBy(*keys).agg(best).select(*keys, (-F.col("best.m")).alias("lag"), F.col("best.c").alias("c"))


class PrefixQuantile:
    """The value at place floor(q (n - 1)) of the sorted values so far, for a growing n: two heaps that meet there."""

    def __init__(self, q: float):
        self.q, self.low, self.high = q, [], []  # low: negated, up to and with the wanted place

    def add(self, value: float) -> None:
        if self.low and value < -self.low[0]:
            heapq.heappush(self.low, -value)
        else:
            heapq.heappush(self.high, value)
        wanted = int(self.q * (len(self.low) + len(self.high) - 1)) + 1
        while len(self.low) > wanted:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        while len(self.low) < wanted:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    @property
    def value(self) -> float:
        return -self.low[0]


def runs(q: Iterable[float], threshold: float) -> list[tuple[int, int, float]]:
    """(first, frames, severity) of each run over the threshold, in one pass over a key's frames."""
    so_far, out, first = PrefixQuantile(0.9), [], None
    i = -1
    for i, value in enumerate(q):
        so_far.add(value)
        if value > threshold:
            first = i if first is None else first
        elif first is not None:
            out.append((first, i - first, min(1.0, max(0.0, so_far.value))))
            first = None
    return out if first is None else [*out, (first, i + 1 - first, 1.0)]


def events(frames: DataFrame, keys: list[str], threshold: float = 0.58) -> DataFrame:
    """Runs of frames over the threshold (frames: keys, i consecutive from 0, q): first, frames, severity. The severity
    is the 0.9 quantile of all frames up to the one that closes the run, 1 for a run that stays open. A key's frames are
    those of one recording; they pass once, and the quantile goes along."""
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def told(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = runs(part.sort_values("i")["q"].tolist(), threshold)
        columns = {k: [v] * len(found) for k, v in zip(keys, key, strict=True)}
        return pd.DataFrame(columns | {"first": [f for f, _, _ in found], "frames": [n for _, n, _ in found], "severity": [s for _, _, s in found]})

    # Keys without a bad frame have no run: only the others go to Python.
    bad = frames.where(F.col("q") > threshold).select(*keys).distinct()
    return frames.select(*keys, "i", "q").join(bad, keys, "left_semi").groupBy(*keys).applyInPandas(told, f"{kinds}, first long, frames long, severity double")


__all__ = ["asymmetry", "bandwidth", "best_lag", "blocks", "compare_frame", "cosine", "dft_power", "dot", "events", "lag_correlation", "log_band_energies", "tilt", "unit_sum"]
