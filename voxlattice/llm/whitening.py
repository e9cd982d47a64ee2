"""Whitening of embeddings: the leading components of the covariance by matrix-free block Lanczos.

Vectors of whole numbers are staged once as packed blocks. The covariance is never formed: a pass sends the current
block of directions (dimensions x width) to all tasks, each task multiplies its own centred rows twice (X'(X v)), and
the products are added up in a tree. The blocks found span a Krylov space, kept orthogonal in full (each new block is
made orthogonal to all before it, twice); where a block's rest loses rank (breakdown), fresh directions orthogonal to
everything found so far restart it. The small projected matrix gives approximate pairs, and a pair is done when its own
residual |V u - e u| is below a share of the largest value. A space that has reached `most` blocks restarts from its best pairs, so
what the driver holds is bounded by dimensions x (most x width), whatever the rows.

Sums are taken in whole numbers and are exact; rows are centred as (n x - S) / n before they are multiplied. The trace
comes from the rows' exact deviations, so a component's share of the variance needs no other component.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out; vectors of each
length are a fit of their own; a component whose variance is nothing against the largest (a null direction: equal rows,
fewer rows than dimensions) is not returned, so there are fewer rows a vector where the rank is below `components`, and
none where all vectors are equal; equal rows and rows of one id are separate rows; null ids are returned as they are; an
empty table gives no rows; extra columns are ignored. Entries or sums that pass 63 bits raise an error."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vector_links import sound

#: What a pair's residual may be of the largest value, and a value of the largest to count as one.
CONVERGED, NOTHING = 1e-13, 1e-12
#: Partial products are added up over so many groups, then so many, then by the driver.
FANS = (4096, 64)


def whole_numbers(vectors: DataFrame, scale: float, shift: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x = floor(scale * c) + shift of every sound vector's entries c, taken as doubles."""
    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    return vectors.where(sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _rows(column, dim: int) -> np.ndarray:
    """Packed vectors of one Arrow column, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


class Rows:
    """The staged vectors of one length, and what one pass over them adds up."""

    def __init__(self, packed: DataFrame, dim: int, n: int, total: list[int]):
        self.packed, self.dim, self.n = packed, dim, n
        sums = np.array(total, np.int64)
        #: n x - S, exact: neither part passes 63 bits.
        self.scaled = lambda x: x * np.int64(n) - sums

    def added(self, make) -> np.ndarray:
        """The sum over tasks of the arrays that `make` gives for a task's centred rows, batch by batch."""
        dim, n, scaled = self.dim, self.n, self.scaled

        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    got = make(scaled(_rows(batch.column(0), dim)) / float(n))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            # In order, so that reruns agree.
            rows = np.array([np.frombuffer(p) for p in parts.sort_values("task")["part"]])
            return pd.DataFrame({"task": [parts["group"].iloc[0]], "part": [rows.sum(0).tobytes()]})

        parts = self.packed.select("x").mapInArrow(run, "part binary").withColumn("task", F.spark_partition_id())
        for fan in FANS:
            parts = parts.withColumn("group", F.pmod("task", F.lit(fan))).groupBy("group").applyInPandas(add, "task int, part binary")
        found = sorted(parts.collect(), key=lambda r: r["task"])
        return np.array([np.frombuffer(r["part"]) for r in found]).sum(0)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions."""
        return self.added(lambda y: (y.T @ (y @ block)).ravel()).reshape(block.shape) / self.n


def _fresh(basis: np.ndarray, block: np.ndarray, rng: np.random.Generator, floor: float) -> np.ndarray:
    """Orthonormal directions of the block's rest beyond the basis; where the rest has lost rank, random ones take the
    place of what is missing, as far as the space has any left."""
    dim, wanted = block.shape[0], min(block.shape[1], block.shape[0] - basis.shape[1])
    out = np.empty((dim, 0))
    for turn in range(3):
        held = np.concatenate([basis, out], axis=1)
        for _ in range(2):
            block = block - held @ (held.T @ block)
        q, size, _ = np.linalg.svd(block, full_matrices=False)
        q = q[:, size > floor][:, : wanted - out.shape[1]]
        for _ in range(2):  # short rests are not orthogonal to working precision yet
            q = np.linalg.qr(q - held @ (held.T @ q))[0]
        out = np.concatenate([out, q], axis=1)
        if out.shape[1] == wanted:
            break
        block, floor = rng.standard_normal((dim, wanted - out.shape[1])), 1e-6
    return out


def block_lanczos(times, dim: int, wanted: int, width: int = 16, most: int = 12, seed: int = 7, passes: int = 200):
    """(values, vectors) of the `wanted` largest eigenpairs of a symmetric positive matrix that only `times` knows."""
    rng = np.random.default_rng(seed)
    width = min(dim, max(width, wanted))
    basis, image = np.empty((dim, 0)), np.empty((dim, 0))
    block = _fresh(basis, rng.standard_normal((dim, width)), rng, 0.0)
    for _ in range(passes):
        basis = np.concatenate([basis, block], axis=1)
        image = np.concatenate([image, times(block)], axis=1)
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        vector, rest = basis @ turn, image @ turn
        residual = np.sqrt(((rest - vector * value) ** 2).sum(0))
        top = max(value[0], 0.0)
        if basis.shape[1] == dim or (residual[:wanted] <= CONVERGED * top).all():
            break
        if basis.shape[1] + width > most * width:
            # The best pairs, whose images are known, start a new space; their residuals go on from there.
            basis, image = vector[:, : 2 * width], rest[:, : 2 * width]
            basis, r = np.linalg.qr(basis)
            image = np.linalg.solve(r.T, image.T).T
            open_ = (rest - vector * value)[:, :width]
        else:
            open_ = image[:, -block.shape[1] :]
        block = _fresh(basis, open_, rng, max(top, 1e-300) * 1e-15)
    else:
        raise RuntimeError(f"no convergence after {passes} passes; residuals {residual[:wanted] / top}")
    return value[:wanted], vector[:, :wanted]


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "x", width: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error for each row and component.
    `vector_col` holds whole numbers (array<bigint>) without nulls."""
    scratch = Scratch(rows.sparkSession, "whitening")
    v = F.col(vector_col)
    rows = rows.where(F.coalesce(F.size(v) > 0, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dim"), v.cast("array<bigint>").alias("x"))

    def pack(batches):
        for batch in batches:
            ids, dims, x = batch.columns
            flat, dims = x.flatten().to_numpy(), dims.to_numpy()
            ends = np.cumsum(dims)
            packed = [flat[e - d : e].astype("<i8").tobytes() for e, d in zip(ends.tolist(), dims.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "dim", "x"])

    packed = scratch.stage(rows.mapInArrow(pack, "vec_id long, dim int, x binary"), "packed")
    lengths = sorted(r["dim"] for r in packed.select("dim").distinct().collect())
    parts = [_whitened(scratch, packed.where(F.col("dim") == d), d, components, width) for d in lengths]
    out = rows.sparkSession.createDataFrame([], WHITENED) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _sums(packed: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """Rows, the sum of each dimension and the largest entry, exact."""

    def run(batches):
        n, low, high, most = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = _rows(batch.column(0), dim)
            if len(x):
                # Halves of 32 bits: neither sum passes 63 bits below 2**31 rows a task.
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
                most = max(most, *(abs(int(e)) for e in (x.max(), x.min())))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[(int(h) << 32) + int(w) for h, w in zip(high, low, strict=True)]], pa.list_(pa.decimal128(38, 0))), pa.array([most], pa.decimal128(38, 0))], ["n", "total", "most"])

    per_task = packed.select("x").mapInArrow(run, "n long, total array<decimal(38,0)>, most decimal(38,0)")
    totals = per_task.select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    n, most = per_task.agg(F.sum("n"), F.max("most")).first()
    return n, [int(r["s"]) for r in sorted(totals, key=lambda r: r["pos"])], int(most)


def _whitened(scratch: Scratch, packed: DataFrame, dim: int, components: int, width: int) -> DataFrame:
    spark = packed.sparkSession
    n, total, most = _sums(packed, dim)
    if max(n * most, *map(abs, total)) * 2 >= 1 << 63:
        raise OverflowError(f"{n} rows with entries up to {most} pass 63 bits")
    rows = Rows(packed, dim, n, total)
    deviations = scratch.stage(_deviations(rows), f"deviations-{dim}")
    trace = int(deviations.agg(F.sum("deviation")).first()[0] or 0) / n**3
    value, vector = block_lanczos(rows.times, dim, min(components, dim), width) if trace else (np.zeros(0), np.zeros((dim, 0)))
    kept = value > NOTHING * max([trace, *value])
    value, vector = value[kept], vector[:, kept]
    if not len(value):
        return spark.createDataFrame([], WHITENED)
    onto, k = vector / np.sqrt(value), len(value)

    def moments(y: np.ndarray) -> np.ndarray:
        w = y @ onto
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    found = rows.added(moments) / n
    mean = found[k * k :]
    error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    scaled, explained = rows.scaled, (value / trace).tolist()

    def run(batches):
        for batch in batches:
            w = scaled(_rows(batch.column(1), dim)) / float(n) @ onto
            ids, deviation = (batch.column(i).take(pa.array(np.repeat(np.arange(len(w)), k))) for i in (0, 2))
            fixed = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(w)), np.full(w.size, n), w.ravel(), np.tile(explained, len(w)), np.full(w.size, error)]
            component, count, whitened, share, off = map(pa.array, fixed)
            yield pa.RecordBatch.from_arrays([ids, component, count, deviation, whitened, share, off], [f.split()[0] for f in WHITENED.split(", ")])

    return deviations.select("vec_id", "x", "deviation").mapInArrow(run, WHITENED)


def _deviations(rows: Rows) -> DataFrame:
    """Each row's sum over dimensions of (n x - S)^2, exact: in 64 bits where it fits, else in Python's integers."""
    dim, scaled = rows.dim, rows.scaled

    def run(batches):
        for batch in batches:
            y = scaled(_rows(batch.column(1), dim))
            if not len(y):
                continue
            if float(np.abs(y).max()) ** 2 * dim < 2.0**62:
                own = (y * y).sum(1).tolist()
            else:
                own = [sum(int(e) * int(e) for e in row) for row in y]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.decimal128(38, 0))], ["vec_id", "x", "deviation"])

    return rows.packed.select("vec_id", "x").mapInArrow(run, "vec_id long, x binary, deviation decimal(38,0)")
