"""Monotone fits: projected gradient descent with weights that stay at or above zero, for a grid of penalties at once and
over tables of any size.

A row whose estimate is clipped (at 1 or 5) gives no gradient; those that are not clipped give one that is linear in the
weights. A row's state can change only once the weights have moved further than its margin over the length of its
features. So one pass over the table keeps, for each penalty, the rows of the least such radii one by one (a bounded
number, `near`), and of all other rows only the sums that their gradient is made of. From these the epochs go on, exactly
as over all rows, until the weights have moved by the least radius among the summed rows; then comes the next pass. Partial
sums are added up in a tree of tasks, and the epochs run in its root, a task a penalty: the driver holds the weights alone.
A pass is worth one epoch at least, and all of them where the table has at most `near` rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlattice.functions.columns import clamp
from voxlattice.session import staged

_PARTIAL = "at int, part int, gram array<double>, aim array<double>, n double, near array<double>, outside double"
#: What stands before a near row's features: its radius, whether it is unclipped, its count, the sum of its labels.
_HEAD = 4


def descend(
    x: np.ndarray, y: np.ndarray, epochs: int, rate: float, l2: float, decay: float = 0.7, every: int = 3000, start: float | list[float] = 0.5, bias: float = 0.02
) -> np.ndarray:
    """Weights and, last, the bias of 5 - bias - x w, fitted to rows in memory. The rate falls after epochs `every`, 2
    `every` and so on, counted from 0."""
    sums = Sums(x.shape[1] + 1, len(y))
    sums.add(_rows(_with_one(x), np.ones(len(y)), y, np.zeros(x.shape[1] + 1)))
    return sums.advance(np.append(np.zeros(x.shape[1]) + start, bias), 0, epochs, rate, l2, decay, every)[0]


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _unclipped(raw: np.ndarray) -> np.ndarray:
    return (raw > 1) & (raw < 5)


def _rows(z: np.ndarray, n: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    raw = 5 - z @ theta
    radius = np.minimum(np.abs(raw - 1), np.abs(raw - 5)) / np.sqrt((z * z).sum(1)) * (1 - 1e-9)
    return np.column_stack([radius, _unclipped(raw), n, y, z])


class Sums:
    """The rows nearest to being clipped or unclipped, and the sums of all others."""

    def __init__(self, width: int, most: int):
        self.most, self.n, self.outside = most, 0.0, np.inf
        self.gram, self.aim, self.near = np.zeros((width, width)), np.zeros(width), np.zeros((0, _HEAD + width))

    def add(self, rows: np.ndarray) -> None:
        self.n += rows[:, 2].sum()
        self._keep(rows)

    def _keep(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.near, rows])
        if len(rows) > self.most:
            order = np.argsort(rows[:, 0], kind="stable")
            rest, rows = rows[order[self.most :]], rows[order[: self.most]]
            self.outside = min(self.outside, rest[0, 0])
            rest = rest[rest[:, 1] > 0]
            z, n = rest[:, _HEAD:], rest[:, 2]
            self.gram += z.T @ (z * n[:, None])
            self.aim += z.T @ (5 * n - rest[:, 3])
        self.near = rows

    def merge(self, part) -> None:
        """Add a partial result (a row of _PARTIAL)."""
        self.n, self.outside = self.n + part.n, min(self.outside, part.outside)
        self.gram += np.reshape(part.gram, self.gram.shape)
        self.aim += part.aim
        self._keep(np.reshape(part.near, (-1, self.near.shape[1])))

    def partial(self, at: int, part: int) -> dict:
        return {"at": at, "part": part, "gram": self.gram.ravel().tolist(), "aim": self.aim.tolist(), "n": self.n, "near": self.near.ravel().tolist(), "outside": float(self.outside)}

    def advance(self, theta: np.ndarray, epoch: int, epochs: int, rate: float, l2: float, decay: float, every: int) -> tuple[np.ndarray, int]:
        """Weights and epoch where the epochs end, or where a summed row might change its state."""
        first, n, y, z = theta, self.near[:, 2], self.near[:, 3], self.near[:, _HEAD:]
        while epoch < epochs:
            moved = np.sqrt(((theta - first) ** 2).sum())
            if moved and moved >= self.outside:
                break
            raw = 5 - z @ theta
            gradient = self.aim - self.gram @ theta + z.T @ np.where(_unclipped(raw), n * raw - y, 0)
            step = rate * decay ** (max(0, epoch - 1) // every)
            theta = np.maximum(0, theta + step * 2 * (gradient / self.n - l2 * np.append(theta[:-1], 0)))
            epoch += 1
        return theta, epoch


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = _with_one(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
    return z, batch.column("n").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)


def _pass(table: DataFrame, tasks: int, open_: dict[int, tuple[np.ndarray, int]], penalties: list[float], near: int, epochs: int, descent: tuple) -> DataFrame:
    """at, theta, epoch of the penalties that are not at their end."""
    width = len(next(iter(open_.values()))[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {at: Sums(width, near) for at in open_}
        for batch in batches:
            if batch.num_rows:
                z, n, y = _arrays(batch)
                for at, (theta, _) in open_.items():
                    sums[at].add(_rows(z, n, y, theta))
        part = TaskContext.get().partitionId()
        for at, s in sums.items():
            if s.n:
                yield pa.RecordBatch.from_pylist([s.partial(at, part)], schema=_schema())

    def together(parts: pd.DataFrame) -> Sums:
        sums = Sums(width, near)
        for part in parts.sort_values("part").itertuples(index=False):
            sums.merge(part)
        return sums

    def middle(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([together(parts).partial(int(parts["at"].iloc[0]), int(parts["part"].min()))])

    def root(parts: pd.DataFrame) -> pd.DataFrame:
        at = int(parts["at"].iloc[0])
        rate, decay, every = descent
        theta, epoch = together(parts).advance(*open_[at], epochs, rate, penalties[at], decay, every)
        return pd.DataFrame({"at": [at], "theta": [theta.tolist()], "epoch": [epoch]})

    partials = table.mapInArrow(summed, _PARTIAL)
    if tasks > 64:
        partials = partials.groupBy("at", F.pmod("part", F.lit(int(tasks**0.5)))).applyInPandas(middle, _PARTIAL)
    return partials.groupBy("at").applyInPandas(root, "at int, theta array<double>, epoch long")


def _schema() -> pa.Schema:
    number, numbers = pa.float64(), pa.list_(pa.float64())
    return pa.schema([("at", pa.int32()), ("part", pa.int32()), ("gram", numbers), ("aim", numbers), ("n", number), ("near", numbers), ("outside", number)])


def _figures(table: DataFrame, thetas: list[np.ndarray]) -> dict[int, dict[str, float]]:
    """rmse, pearson and bias of each penalty's estimates, where there are rows (a correlation of 0 without variance)."""
    columns = ("n", "e", "ee", "ey", "y", "yy")
    schema = pa.schema([("at", pa.int32()), *[(c, pa.float64()) for c in columns]])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, n, y = _arrays(batch)
            yy = batch.column("yy").to_numpy(zero_copy_only=False)
            for at, theta in enumerate(thetas):
                e = np.clip(5 - z @ theta, 1, 5)
                figures = (n.sum(), n @ e, n @ (e * e), e @ y, y.sum(), yy.sum())
                yield pa.RecordBatch.from_pylist([{"at": at, **dict(zip(columns, map(float, figures), strict=True))}], schema=schema)

    sums = table.mapInArrow(summed, "at int, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*[F.sum(c).alias(c) for c in columns])
    n = F.col("n")
    spread = lambda square, plain: F.greatest(F.col(square) / n - F.pow(F.col(plain) / n, F.lit(2.0)), F.lit(0.0))
    both = spread("ee", "e") * spread("yy", "y")
    together = F.col("ey") / n - F.col("e") * F.col("y") / (n * n)
    found = sums.where("n > 0").select(
        "at",
        F.sqrt(F.greatest((F.col("ee") - 2 * F.col("ey") + F.col("yy")) / n, F.lit(0.0))).alias("rmse"),
        F.when(both > 1e-20, together / F.sqrt(both)).otherwise(0.0).alias("pearson"),
        ((F.col("e") - F.col("y")) / n).alias("bias"),
    )
    return {r["at"]: {k: r[k] for k in ("rmse", "pearson", "bias")} for r in found.collect()}


def fit_grid(
    rows: DataFrame,
    features: list[str],
    label: str,
    penalties: list[float],
    epochs: int,
    rate: float,
    expand: list[Column] | None = None,
    all_rows: bool = False,
    decay: float = 0.7,
    every: int = 3000,
    start: float | list[float] = 0.5,
    bias: float = 0.02,
    near: int = 1024,
) -> DataFrame:
    """l2, rmse, pearson, bias (on split dev; estimate less label), weights (and, last, the bias): rows have split train or
    dev. `all_rows`: both are learnt, and the figures are on both. `expand`: what the model sees, made of the features (by
    default these themselves). Rows with a null or NaN among features and label are left out; equal rows count as often as
    they occur. Raises ValueError where nothing is left to learn from."""
    spark = rows.sparkSession
    # What a row tells of its features is how often it occurs and what its labels sum up to.
    truth, dev = clamp(F.col(label).cast("double"), 1, 5), F.lit(True) if all_rows else F.col("split") == "dev"
    plain = rows.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"f{i}") for i, c in enumerate(features)], F.nanvl(truth, F.lit(None).cast("double")).alias("truth"), F.coalesce(dev, F.lit(False)).alias("dev")).dropna()
    keys = [*[f"f{i}" for i in range(len(features))], "dev"]
    told = staged(plain.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum("truth").alias("y"), F.sum(F.col("truth") * F.col("truth")).alias("yy")), "fit")
    named = told.select(*[F.col(f"f{i}").alias(c) for i, c in enumerate(features)], *[F.col(c).alias(f"_{c}") for c in ("dev", "n", "y", "yy")])
    table = named.select(F.array(*(expand or [F.col(c) for c in features])).alias("x"), *[F.col(f"_{c}").alias(c) for c in ("dev", "n", "y", "yy")])
    learnt = table.where(F.lit(True) if all_rows else ~F.col("dev"))
    some = learnt.first()
    if some is None:
        raise ValueError("no rows")
    tasks = table.select(F.spark_partition_id()).distinct().count()
    states = {at: (np.append(np.zeros(len(some["x"])) + start, bias), 0) for at in range(len(penalties))}
    while open_ := {at: state for at, state in states.items() if state[1] < epochs}:
        for r in _pass(learnt, tasks, open_, penalties, near, epochs, (rate, decay, every)).collect():
            states[r["at"]] = (np.array(r["theta"]), r["epoch"])
    thetas = [states[at][0] for at in range(len(penalties))]
    figures = _figures(table.where("dev"), thetas)
    none = {"rmse": 0.0, "pearson": 0.0, "bias": 0.0}
    out = [(p, *figures.get(at, none).values(), thetas[at].tolist()) for at, p in enumerate(penalties)]
    return spark.createDataFrame(out, "l2 double, rmse double, pearson double, bias double, weights array<double>")


def fit_best(rows: DataFrame, features: list[str], label: str, penalties: list[float], epochs: int, last_epochs: int, rate: float, **fitted) -> DataFrame:
    """l2, rmse, pearson, bias (on split dev), weights: the penalty that is best on dev after training on train, with the
    weights of another fit on train and dev."""
    chosen = best(fit_grid(rows, features, label, penalties, epochs, rate, **fitted)).first()
    final = fit_grid(rows, features, label, [chosen["l2"]], last_epochs, rate, all_rows=True, **fitted)
    return final.select("l2", *[F.lit(chosen[c]).alias(c) for c in ("rmse", "pearson", "bias")], "weights")


def best(grid: DataFrame) -> DataFrame:
    """The penalty with the least error on dev; of equal ones the least."""
    return grid.orderBy("rmse", "l2").limit(1)
