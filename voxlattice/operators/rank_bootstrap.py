"""Cluster bootstrap of Pearson and Spearman deltas, with no row drawn.

A draw gives each cluster a multiplicity. A row's average rank in the drawn rows is a half and, over all clusters, the
multiplicity times the number of that cluster's rows below it (ties count half): it is linear in the multiplicities.
So sums of rank products over a draw are cubic forms whose coefficients do not depend on the draw. One pass over the rows
gives them (clusters x clusters x clusters numbers), and a draw then costs as much for a thousand rows as for a billion.

The counts below a value are running sums over its distinct values, dealt by range; rows meet them by equality joins.
Clusters are few (speakers, emotions): more than MOST are refused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.functions.columns import draw
from voxlattice.session import staged

MOST = 200
#: The products of ranks (t: truth, p and q: the predictions) that the two correlations need.
PRODUCTS = ("tt", "pp", "qq", "tp", "tq")
#: Partial forms are added up over so many groups before the driver adds those.
GROUPS = 64
#: Counts (values x clusters) that a broadcast may hold: 2 MB.
FEW = 1 << 18


def _below(rows: DataFrame, x: str, clusters: int) -> DataFrame:
    """x and, for each of its values, the number of each cluster's rows below it; equal ones count half."""
    own = [F.sum(F.when(F.col("c") == k, F.col("n")).otherwise(0)).cast("double").alias(f"k{k}") for k in range(clusters)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = staged(rows.groupBy(x).agg(*own).repartitionByRange(parts, x).withColumn("_part", F.spark_partition_id()), "below")
    sums = values.groupBy("_part").agg(*[F.sum(f"k{k}").alias(f"s{k}") for k in range(clusters)])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    sums = sums.select("_part", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0.0)).alias(f"s{k}") for k in range(clusters)])
    inside = W.partitionBy("_part").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    running = values.select(x, "_part", *[F.coalesce(F.sum(f"k{k}").over(inside), F.lit(0.0)).alias(f"r{k}") for k in range(clusters)], *[f"k{k}" for k in range(clusters)])
    met = running.join(F.broadcast(sums), "_part")
    return met.select(x, F.array(*[F.col(f"s{k}") + F.col(f"r{k}") + F.col(f"k{k}") / 2 for k in range(clusters)]).alias(f"below_{x}"))


def rank_forms(rows: DataFrame, clusters: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Rows of each cluster; for t, p, q the sums over a cluster's rows of the counts below [cluster, cluster]; for each
    product the sums of the counts' products [cluster, cluster, cluster]. rows: c (cluster number), t, p, q."""
    rows = staged(rows.groupBy("c", "t", "p", "q").agg(F.count("*").alias("n")), "rank-rows")
    # The measure of the most values first, while rows are narrow; counts of few values are broadcast, so no row that
    # carries counts is dealt out again.
    values = rows.agg(*[F.approx_count_distinct(x).alias(x) for x in "tpq"]).first()
    met = rows
    for x in sorted("tpq", key=lambda x: -values[x]):
        counts = _below(rows, x, clusters)
        met = met.join(F.broadcast(counts) if values[x] * clusters <= FEW else counts.hint("merge"), x)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3 + len(PRODUCTS) * clusters, clusters, clusters))
        for part in batches:
            n, of = part["n"].to_numpy().astype(np.float64), part["c"].to_numpy()
            below = {x: part[f"below_{x}"].flatten().to_numpy().reshape(-1, clusters) for x in "tpq"}
            for c in np.unique(of):
                at = of == c
                for k, x in enumerate("tpq"):
                    sums[k, c] += n[at] @ below[x][at]
                for k, (x, y) in enumerate(PRODUCTS):
                    sums[3 + k * clusters + c] += (n[at, None] * below[x][at]).T @ below[y][at]
        if sums.any():
            yield pa.RecordBatch.from_pydict({"part": [sums.tobytes()]})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("task")["part"]
        return pd.DataFrame({"part": [np.sum([np.frombuffer(p) for p in rows], axis=0).tobytes()]})

    sent = met.select("c", "n", *[f"below_{x}" for x in "tpq"]).mapInArrow(add, "part binary").withColumn("task", F.spark_partition_id())
    found = sent.withColumn("group", F.pmod("task", F.lit(GROUPS))).groupBy("group").applyInPandas(total, "part binary").collect()
    sums = np.sum([np.frombuffer(r["part"]) for r in found], axis=0).reshape(-1, clusters, clusters) if found else np.zeros((3 + len(PRODUCTS) * clusters, clusters, clusters))
    sizes = np.zeros(clusters)
    for r in rows.groupBy("c").agg(F.sum("n").alias("n")).collect():
        sizes[r["c"]] = r["n"]
    cubes = sums[3:].reshape(len(PRODUCTS), clusters, clusters, clusters)
    return sizes, dict(zip("tpq", sums[:3], strict=True)), dict(zip(PRODUCTS, cubes, strict=True))


def _cubic(m: np.ndarray, cube: np.ndarray) -> np.ndarray:
    """The cubic form of each row of m, a few rows at a time."""
    rows, size = max(1, (1 << 22) // cube[0].size), len(cube)
    out = []
    for at in range(0, len(m), rows):
        some = m[at : at + rows]
        square = (some @ cube.reshape(size, -1)).reshape(len(some), size, size)
        out.append(((some[:, None, :] @ square)[:, 0] * some).sum(1))
    return np.concatenate(out) if out else np.zeros(0)


def spearman_deltas(m: np.ndarray, sizes: np.ndarray, single: dict[str, np.ndarray], cubes: dict[str, np.ndarray]) -> np.ndarray:
    """Spearman of p less that of q, for each row of multiplicities; NaN where a side has no spread."""
    n = m @ sizes
    form = {}
    for name in PRODUCTS:
        once = sum(np.einsum("dc,ca,da->d", m, single[x], m, optimize=True) for x in name)
        form[name] = n / 4 + once / 2 + _cubic(m, cubes[name]) - n * ((n + 1) / 2) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        least = 1e-9 * n**3
        rho = {x: np.where((form["tt"] > least) & (form[x * 2] > least), form[f"t{x}"] / np.sqrt(form["tt"] * form[x * 2]), np.nan) for x in "pq"}
    return rho["p"] - rho["q"]


def cluster_correlations(rows: DataFrame, turns: int, seed: str) -> DataFrame:
    """turn, delta_pearson, delta_spearman: of pred less of pred2 over whole clusters drawn with replacement, as many as
    there are; null where a correlation is not defined. rows: cluster, truth, pred, pred2; rows with a null are left
    out."""
    spark = rows.sparkSession
    rows = rows.select("cluster", *[F.col(c).cast("double").alias(x) for c, x in (("truth", "t"), ("pred", "p"), ("pred2", "q"))]).dropna()
    names = [r["cluster"] for r in rows.select("cluster").distinct().orderBy("cluster").limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} clusters")
    count = len(names)
    if not count:
        return spark.createDataFrame([], "turn long, delta_pearson double, delta_spearman double")
    numbers = spark.createDataFrame(list(zip(names, range(count), strict=True)), f"cluster {rows.schema['cluster'].dataType.simpleString()}, c int")
    rows = rows.join(F.broadcast(numbers), "cluster").drop("cluster")
    sizes, single, cubes = rank_forms(rows, count)

    x, y, z = F.col("t"), F.col("p"), F.col("q")
    terms: dict[str, Column] = {"n": F.lit(1.0), "t": x, "p": y, "q": z, "tt": x * x, "pp": y * y, "qq": z * z, "tp": x * y, "tq": x * z}
    own = {r["c"]: [r[k] for k in terms] for r in rows.groupBy("c").agg(*[F.sum(v).alias(k) for k, v in terms.items()]).collect()}
    moments, columns = np.array([own[c] for c in range(count)]), list(terms)

    turn = spark.range(turns).select(F.col("id").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw_no"))
    drawn = turn.select("turn", draw(F.lit(count).cast("long"), F.lit(seed), F.col("turn"), F.col("draw_no")).alias("pos"))
    times = drawn.groupBy("turn").agg(F.array(*[F.count_if(F.col("pos") == k).cast("double") for k in range(count)]).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            m = np.stack(part["m"].to_list())
            s = dict(zip(columns, (m @ moments).T, strict=True))
            with np.errstate(divide="ignore", invalid="ignore"):
                spread = lambda a: s["n"] * s[a * 2] - s[a] ** 2
                r = lambda a: np.where((spread("t") > 0) & (spread(a) > 0), (s["n"] * s[f"t{a}"] - s["t"] * s[a]) / np.sqrt(spread("t") * spread(a)), np.nan)
                yield pd.DataFrame({"turn": part["turn"], "delta_pearson": r("p") - r("q"), "delta_spearman": spearman_deltas(m, sizes, single, cubes)})

    return times.mapInPandas(run, "turn long, delta_pearson double, delta_spearman double")
