"""Exact top-k by inner product, with a KD-tree for each shard of the candidates.

Candidates are dealt to shards by hash; each shard's tree (median splits, tight bounding boxes) is built once and
staged. Queries are dealt to blocks; a tree and a block meet in one task, which finds for each query which leaves its
box-to-query bounds let in, best first, and stops at the kth score so far. The search runs in two waves: each block
first meets one shard, and the kth scores found there travel with the queries to all other shards, where they prune
from the start.

The work is (queries x shards) by its nature; a tree is copied once for each block of 65536 queries and a query once
for each shard, so that nothing is collected and memory is bounded by one shard and one block, whatever the input.

Scores are exact: in double precision where products cannot pass 2**53, in 64-bit integers beyond that.

Defined results: rows whose vector is null, empty or holds null or non-finite components, or whose id is null, take no
part; vectors of different lengths do not meet; equal rows, and rows of one id, are separate candidates and separate
queries, and only a query's own row is not its candidate; with fewer candidates than k, all are returned; an empty table
gives no rows; extra columns are ignored. Scores beyond 64 bits raise an error."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket

FOUND = "query_row long, query_id long, row long, vec_id long, score long"


class Tree:
    """Nodes of each level from the root down; a node is a run of rows in `order`, halved at the median of its widest
    dimension, and its box is tight."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(points))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        runs = [(0, len(points))]
        while True:
            boxes = [points[self.order[a:b]] for a, b in runs]
            low, high = np.array([x.min(0) for x in boxes]), np.array([x.max(0) for x in boxes])
            self.levels.append((np.array(runs), low, high))
            if max(b - a for a, b in runs) <= leaf_rows:
                return
            halves = []
            for (a, b), lo, hi in zip(runs, low, high, strict=True):
                mid, wide = (a + b) // 2, (hi - lo).argmax()
                if b - a < 2:
                    halves += [(a, b), (a, b)]
                    continue
                part = self.order[a:b]
                self.order[a:b] = part[np.argpartition(points[part, wide], mid - a)]
                halves += [(a, mid), (mid, b)]
            runs = halves

    def bounds(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The most that each query can score in each leaf; below a node that cannot reach the query's `least`, -inf."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        alive = np.ones((len(queries), 1), bool)
        for level, (_, low, high) in enumerate(self.levels):
            if level:
                alive = np.repeat(alive, 2, axis=1)
            best = np.where(alive, up @ high.T + down @ low.T, -np.inf)
            alive = best >= least[:, None]
        return np.where(alive, best, -np.inf)


    def packed(self) -> bytes:
        return pickle.dumps((self.order, self.levels), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> "Tree":
        tree = cls.__new__(cls)
        tree.order, tree.levels = pickle.loads(data)
        return tree


_NONE = np.iinfo(np.int64).min


def search(tree: Tree, points: np.ndarray, rank: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
    """(query index, point index, score) of each query's best k among the points that reach its `least`. rank: places of
    points among those of the shard, by id; own: the point that is the query itself, or -1. Points and queries are whole
    numbers."""
    if not len(points) or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs = tree.levels[-1][0]
    far = max(1.0, float(np.abs(points).max())) * max(1.0, float(np.abs(queries).max())) * points.shape[1]
    width = len(points) + 1
    exact = far < 1 << 53
    coded = far * width < 1 << 62
    real = queries.astype(np.float64)
    slack = 0.0 if exact else far * 1e-12  # what rounding can take from a bound
    bound = tree.bounds(real, least - slack) + slack
    turn = np.argsort(-bound, axis=1, kind="stable")
    best = [np.full((len(queries), k), _NONE, np.int64), np.full((len(queries), k), -1, np.int64)]  # score, point
    by_rank = np.argsort(rank, kind="stable")
    floats = points.astype(np.float64) if exact else None
    least = least.copy()
    for step in range(len(runs)):
        leaf = turn[:, step]
        reach = bound[np.arange(len(queries)), leaf]
        go = np.flatnonzero((reach >= least) & np.isfinite(reach))
        if not len(go):
            break  # the bounds fall from turn to turn
        go = go[np.argsort(leaf[go], kind="stable")]
        for part in np.split(go, np.flatnonzero(np.diff(leaf[go])) + 1):
            a, b = runs[leaf[part[0]]]
            rows = tree.order[a:b]
            mine = own[part][:, None] == rows[None, :]
            if exact:
                scores = np.rint(real[part] @ floats[rows].T).astype(np.int64)
            else:
                if np.abs(np.where(mine, 0, real[part] @ points[rows].astype(np.float64).T)).max() >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a score does not fit 64 bits")
                scores = queries[part] @ points[rows].T  # modulo 2**64, which is exact for what fits
            for x, y in zip(best, _kept(best[0][part], best[1][part], scores, rows, mine, rank, by_rank, width if coded else 0, k), strict=True):
                x[part] = y
        kth = best[0][go].min(1)
        full = (best[1][go] >= 0).all(1)
        least[go] = np.where(full, np.maximum(least[go], kth.astype(np.float64) * (1 if exact else 1 - np.sign(kth) * 1e-12)), least[go])
    q, at = np.nonzero(best[1] >= 0)
    return q, best[1][q, at], best[0][q, at]


def _kept(score: np.ndarray, point: np.ndarray, scores: np.ndarray, rows: np.ndarray, mine: np.ndarray, rank: np.ndarray, by_rank: np.ndarray, width: int, k: int):
    """The best k of those kept so far (score, point; -1: none) and of the scores of `rows`, without `mine`; ties to the
    smaller rank. With a width, score and rank fit one number."""
    if width:
        old = np.where(point >= 0, score * width + (width - 1 - rank[point]), _NONE)
        new = np.where(mine, _NONE, scores * width + (width - 1 - rank[rows]))
        both = np.concatenate([old, new], axis=1)
        top = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        got = np.floor_divide(top, width)
        there = top != _NONE
        return np.where(there, got, _NONE), np.where(there, by_rank[np.where(there, width - 1 - (top - got * width), 0)], -1)
    wide = np.concatenate([score, scores], axis=1)
    at = np.concatenate([point, np.where(mine, -1, np.broadcast_to(rows, scores.shape))], axis=1)
    places = np.lexsort((np.where(at >= 0, rank[at], 0), ~wide, at < 0), axis=1)[:, :k]
    wide, at = np.take_along_axis(wide, places, 1), np.take_along_axis(at, places, 1)
    return np.where(at >= 0, wide, _NONE), at


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", shard_rows: int = 8192, block_rows: int = 1 << 16, leaf_rows: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score. `vector_col` holds whole numbers (array<bigint>); `is_query` picks the query rows."""
    scratch = Scratch(vectors.sparkSession, "topk")
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull()) & (F.size(v) > 0), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<bigint>").alias("v"), is_query.alias("asks"))
    # A row's number tells it from rows of the same id; it is fixed once it is written.
    rows = scratch.stage(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "rows")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        points = np.array(part["v"].tolist(), np.int64)
        order = np.lexsort((part["row"], part["vec_id"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        parts = [Tree(points.astype(np.float64), leaf_rows).packed(), *(np.asarray(x, np.int64).tobytes() for x in (points, rank, part["row"], part["vec_id"]))]
        return pd.DataFrame([(*key, *parts)], columns=["dim", "shard", "tree", "points", "rank", "rows", "ids"])

    dealt = rows.select("vec_id", "v", "dim", "row", bucket(shards, F.col("row"), F.lit("shard")).alias("shard"))
    trees = dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary, points binary, rank binary, rows binary, ids binary")
    trees = scratch.stage(trees, "trees").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = scratch.read("rows").where("asks").withColumn("block", bucket(blocks, F.col("row"), F.lit("block")))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for tree, points, rank, rows, ids in left[["tree", "points", "rank", "rows", "ids"]].itertuples(index=False):
            tree, (rank, rows, ids) = Tree.unpacked(tree), (np.frombuffer(x, np.int64) for x in (rank, rows, ids))
            points = np.frombuffer(points, np.int64).reshape(len(rows), -1)
            by_row = np.argsort(rows)
            for at in range(0, len(right), 4096):
                part = right.iloc[at : at + 4096]
                row = part["row"].to_numpy()
                own = by_row[np.minimum(np.searchsorted(rows[by_row], row), len(rows) - 1)]
                own = np.where(rows[own] == row, own, -1)
                least = part["least"].astype(float).fillna(-np.inf).to_numpy()
                q, i, score = search(tree, points, rank, np.array(part["v"].tolist(), np.int64), own, least, k)
                found.append(pd.DataFrame({"query_row": row[q], "query_id": part["vec_id"].to_numpy()[q], "row": rows[i], "vec_id": ids[i], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "row", "vec_id", "score")})

    def wave(asking: DataFrame, where: Column) -> DataFrame:
        keys = ["dim", "shard", "block"]
        return trees.where(where).groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(meet, FOUND)

    # First wave: block b meets shard b modulo the number of shards.
    home = F.pmod(F.col("block"), F.lit(shards))
    first = scratch.stage(wave(queries.withColumn("shard", home).withColumn("least", F.lit(None).cast("long")), F.col("shard") == home), "first")
    found = first
    if shards > 1:
        kth = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        asking = queries.join(kth.where(F.col("n") == k), queries["row"] == kth["query_row"], "left").drop("query_row", "n")
        asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
        found = first.unionByName(wave(asking, F.col("shard") != home))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
