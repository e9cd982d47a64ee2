"""Helpers that the operators of this subpackage share: shared storage, staging and flat text buffers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one where a local session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="voxlattice-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


class Scratch:
    """A folder of staged tables for one call. Staging cuts lineage: a lost executor re-reads files instead of
    recomputing everything before them. drop() frees a table that no later plan reads; the rest goes at exit.

    Rows here hold whole texts, so fewer of them than Spark's default go to Python in a batch (unless the session says
    how many)."""

    def __init__(self, spark: SparkSession, label: str):
        if spark.conf.get(_ROWS_A_BATCH) == "10000":
            spark.conf.set(_ROWS_A_BATCH, "1000")
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """A staged table once more, with columns of its own: for joins of a table with itself."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def bucket(n: int, *cols: Column) -> Column:
    """A bucket in [0, n) by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def uniform(*cols: Column) -> Column:
    """A 60-bit non-negative integer from md5, the same in any SQL engine; null counts as the text 'null'."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def freed(run):
    """A function over a task's batches that gives memory back to the machine when it ends: Python workers stay for later
    tasks, and what they no longer use would count against the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Gives freed memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown as needed, for prefix polynomial hashes."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n >= len(self.up):
            size = 1 << n.bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """prefix[i] hashes values[:i]; span() takes differences of it."""
        self.grow(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of values[start:end], the same wherever those values stand."""
        return (prefix[end] - prefix[start]) * self.down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0]+1, ... (count[0] of them), start[1], ..., in one flat array."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def slices(texts: list, most: int):
    """Consecutive slices of a list of texts with about `most` characters each; a longer text stands alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)
