"""Hard-negative mining by dual-tree search: trees over anchors and over candidates, searched together.

A bounded sample of vectors gives median planes; they cut the space into cells, which only decide how tight the boxes
are. The candidates of a cell make a shard (several where the cell is full), the anchors of a group of neighbouring
cells a block. Each shard and each block has a tree of its own, built once and staged: median splits (of labels first,
then of the widest dimension), with a tight box and the labels' range at each node.

A block and a shard meet in one task. Both trees are gone down together: for a pair of nodes, the interval of all inner
products between their boxes is compared with what any anchor of the node still needs, and with the labels, so that
whole groups of anchors are ruled out at once; pairs of leaves are scored exactly, best bound first. What an anchor
needs are windows of scores with the kth best found in them so far. Blocks and shards whose boxes rule each other out
never meet; each block meets one shard first, and the kth scores found there travel with it to the others.

Positives are searched with one open window over rows of the same label; each positive's score then sets a window
over rows of other labels. Of equal rows of one label, only the first few by id can be among the best k, so only they
are candidates. Nothing is collected but the sample; memory is bounded by one block and one shard.

The number of meetings is (blocks x shards) where boxes rule nothing out, as in many dimensions without clusters.

Defined results: rows whose label or vector is null, or whose vector is empty or holds null or non-finite components,
take no part; vectors of different lengths do not meet; rows with a null id are candidates, after all others in ties;
equal rows, and rows of one id, are separate anchors and candidates, and only an anchor's own row is not its candidate;
an anchor without positives, or a positive without negatives, gives no rows; an empty table gives none; extra columns
are ignored. Scores beyond 64 bits raise an error."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .topk import _NONE, _kept

#: Cells are cut by planes through a sample of so many vectors a cell; there are so many cells at most.
SAMPLED, CELLS = 16, 4096
_NEVER = np.iinfo(np.int64).max
FOUND = "block string, at int, window int, anchor_id long, unnamed_anchor boolean, row long, vec_id long, unnamed boolean, score long"


class Tree:
    """levels[l]: (runs, low, high, least label, largest label) of the 2**l nodes of a level; a node is a run of rows in
    `order`, halved at the median, by label where there are several and else along its widest dimension."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf_rows: int):
        self.order, self.levels = np.arange(len(points)), []
        runs = [(0, len(points))]
        while True:
            boxes = [points[self.order[a:b]] for a, b in runs]
            tags = [labels[self.order[a:b]] for a, b in runs]
            low, high = np.array([x.min(0) for x in boxes], np.float64), np.array([x.max(0) for x in boxes], np.float64)
            first, last = np.array([x.min() for x in tags]), np.array([x.max() for x in tags])
            self.levels.append((np.array(runs), low, high, first, last))
            if max(b - a for a, b in runs) <= max(1, leaf_rows):
                return
            halves = []
            for k, (a, b) in enumerate(runs):
                mid, part = (a + b) // 2, self.order[a:b]
                by = tags[k] if first[k] < last[k] else boxes[k][:, (high[k] - low[k]).argmax()]
                self.order[a:b] = part[np.argpartition(by, mid - a)]
                halves += [(a, mid), (mid, b)]
            runs = halves


def _interval(a: tuple, c: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that rows of node i of a level can score with rows of node j of another."""
    least, most = np.empty(len(i)), np.empty(len(i))
    for at in range(0, len(i), 8192):
        p, q = i[at : at + 8192], j[at : at + 8192]
        ends = [x[p] * y[q] for x in a[1:3] for y in c[1:3]]
        most[at : at + 8192] = np.maximum.reduce(ends).sum(1)
        least[at : at + 8192] = np.minimum.reduce(ends).sum(1)
    return least, most


def _meetings(anchors: Tree, shard: Tree, least: np.ndarray, high: np.ndarray, same: bool, slack: float):
    """(anchor leaf, candidate leaf, most) of the pairs of leaves that may hold a hit; least, high: of each anchor, over
    its windows."""
    i = j = np.zeros(1, np.int64)
    up = down = 0
    while True:
        a, c = anchors.levels[up], shard.levels[down]
        starts = a[0][:, 0]
        need, cap = np.minimum.reduceat(least[anchors.order], starts), np.maximum.reduceat(high[anchors.order], starts)
        low, most = _interval(a, c, i, j)
        go = (most + slack >= need[i]) & (low - slack <= cap[i])
        if same:
            go &= (a[3][i] <= c[4][j]) & (c[3][j] <= a[4][i])
        else:
            go &= (a[3][i] != c[4][j]) | (a[4][i] != c[3][j]) | (a[3][i] != a[4][i])
        i, j, most = i[go], j[go], most[go]
        if up == len(anchors.levels) - 1 and down == len(shard.levels) - 1:
            return i, j, most + slack
        if down < len(shard.levels) - 1:
            down, i, j = down + 1, np.repeat(i, 2), np.stack([2 * j, 2 * j + 1], 1).ravel()
        if up < len(anchors.levels) - 1:
            up, i, j = up + 1, np.stack([2 * i, 2 * i + 1], 1).ravel(), np.repeat(j, 2)


def dual_search(block: dict, shard: dict, least: np.ndarray, high: np.ndarray, k: int, same: bool):
    """(anchor, window, candidate, score) of each anchor's best k candidates in each of its windows [least, high], with
    the anchor's label (same) or another. block, shard: tree, points (whole numbers), rows (numbers that tell rows
    apart), labels; shard also ranks, places by id. Ties go to the smaller rank."""
    at, points, rank = block["points"].astype(np.int64), shard["points"].astype(np.int64), shard["ranks"]
    far = max(1.0, float(np.abs(points).max())) * max(1.0, float(np.abs(at).max())) * points.shape[1]
    exact, width = far < 1 << 53, len(points) + 1
    slack = 0.0 if exact else far * 1e-12
    kind = np.float32 if far < 1 << 24 else np.float64  # sums of whole numbers up to there are exact
    left, right = at.astype(kind), points.astype(kind)
    by_rank = np.argsort(rank, kind="stable")
    least, windows = least.copy(), least.shape[1]
    score, found = np.full((len(at), windows, k), _NONE, np.int64), np.full((len(at), windows, k), -1, np.int64)
    i, j, most = _meetings(block["tree"], shard["tree"], least.min(1), high.max(1), same, slack)
    turn = np.lexsort((-most, i))
    i, j, most = i[turn], j[turn], most[turn]
    runs, leaves = block["tree"].levels[-1][0], shard["tree"].levels[-1][0]
    wide = max(1, 2048 // max(1, int((leaves[:, 1] - leaves[:, 0]).max())))
    for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
        a = block["tree"].order[slice(*runs[i[own[0]]])]
        for step in range(0, len(own), wide):
            some = own[step : step + wide]
            some = some[most[some] >= least[a].min()]
            if not len(some):
                break  # bounds fall from step to step
            c = np.concatenate([shard["tree"].order[slice(*leaves[x])] for x in j[some]])
            if exact:
                scores = np.rint(left[a] @ right[c].T).astype(np.int64)
            else:
                if np.abs(left[a] @ right[c].T).max() >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a score does not fit 64 bits")
                scores = at[a] @ points[c].T  # modulo 2**64, which is exact for what fits
            fit = (block["labels"][a][:, None] == shard["labels"][c][None, :]) == same
            fit &= block["rows"][a][:, None] != shard["rows"][c][None, :]
            for w in range(windows):
                hit = fit & (scores >= least[a, w][:, None]) & (scores <= high[a, w][:, None])
                some_hit = np.flatnonzero(hit.any(1))
                if not len(some_hit):
                    continue
                who = a[some_hit]
                held = _kept(score[who, w], found[who, w], scores[some_hit], c, ~hit[some_hit], rank, by_rank, width if far * width < 1 << 62 else 0, k)
                score[who, w], found[who, w] = held
                full = (held[1] >= 0).all(1)
                least[who[full], w] = np.maximum(least[who[full], w], held[0][full].min(1))
    a, w, n = np.nonzero(found >= 0)
    return a, w, found[a, w, n], score[a, w, n]


def _planes(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each level, the dimension and the value at which its cells are halved."""
    planes, cells = [], [sample]
    for _ in range(depth):
        dims = np.array([int((x.max(0) - x.min(0)).argmax()) if len(x) else 0 for x in cells])
        cuts = np.array([np.median(x[:, d]) if len(x) else 0.0 for x, d in zip(cells, dims, strict=True)])
        planes.append((dims, cuts))
        cells = [y for x, d, v in zip(cells, dims, cuts, strict=True) for y in (x[x[:, d] < v], x[x[:, d] >= v])]
    return planes


def _level(n: int, rows: int, least: int) -> int:
    """log2 of a number of cells with about `rows` of n rows each: `least` cells or more, CELLS at most."""
    return int(np.ceil(np.log2(min(CELLS, max(least, n / rows)))))


def _narrow(points: np.ndarray) -> np.ndarray:
    return points.astype(np.min_scalar_type(-1 - int(np.abs(points).max()))) if points.size else points


def _built(leaf_rows: int):
    """A table's rows of one key as one row: its tree and arrays, packed, and the root's box and labels."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["unnamed", "vec_id", "row"], ignore_index=True)  # places are ranks by id
        points, labels = np.array(part["v"].tolist(), np.int64), part["label"].to_numpy(np.int64)
        tree = Tree(points, labels, leaf_rows)
        packed = {"tree": tree, "points": _narrow(points), "labels": labels, "ranks": np.arange(len(part))}
        packed |= {"rows": part["row"].to_numpy(np.int64), "ids": part["vec_id"].to_numpy(np.int64), "unnamed": part["unnamed"].to_numpy(bool)}
        _, low, high, first, last = tree.levels[0]
        one = {"key": part["key"].iloc[0], "dim": points.shape[1], "packed": pickle.dumps(packed, protocol=5)}
        return pd.DataFrame([one | {"low": low[0].tolist(), "high": high[0].tolist(), "first": int(first[0]), "last": int(last[0])}])

    return build


_TREE = "key string, dim int, packed binary, low array<double>, high array<double>, first long, last long"


class _Search:
    """The staged trees of one call and the waves in which blocks meet shards."""

    def __init__(self, scratch: Scratch, shards: DataFrame, blocks: DataFrame):
        self.scratch, self.spark = scratch, scratch.spark
        self.shards = scratch.stage(shards, "shards")
        self.blocks = scratch.stage(blocks, "blocks")
        sides = [t.select(F.col("key").alias(name), "dim", *[F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "first", "last")]) for t, name in ((self.blocks, "block"), (self.shards, "shard"))]
        a, c = ("block_low", "block_high"), ("shard_low", "shard_high")
        ends = F.arrays_zip(*a, *c)
        every = lambda x: [x[p] * x[q] for p in a for q in c]
        pick = lambda f: F.aggregate(F.transform(ends, lambda x: f(*every(x))), F.lit(0.0), lambda s, x: s + x)
        # Directory entries meet, not rows: one line for each tree.
        pairs = sides[0].join(sides[1], "dim").select("block", "shard", pick(F.least).alias("worst"), pick(F.greatest).alias("best"), *[f"{s}_{c}" for s in ("block", "shard") for c in ("first", "last")])
        self.pairs = scratch.stage(pairs, "pairs")

    def asking(self, asks: DataFrame | None, windows: int, open_: bool, name: str) -> DataFrame:
        """Blocks with what their anchors need; asks: block, at, window, least, high. Without asks, or for anchors that
        have none where `open_`, any score will do; else none."""

        def attach(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame(columns=["key", "packed", "asks", "need", "cap"])
            n = len(pickle.loads(left["packed"].iloc[0])["rows"])
            least, high = np.full((n, windows), _NONE if open_ else _NEVER, np.int64), np.full((n, windows), _NEVER if open_ else _NONE, np.int64)
            at, w = right["at"].to_numpy(np.int64), right["window"].to_numpy(np.int64)
            least[at, w], high[at, w] = right["least"].to_numpy(np.int64), right["high"].to_numpy(np.int64)
            return pd.DataFrame({"key": left["key"], "packed": left["packed"], "asks": [pickle.dumps((least, high), protocol=5)], "need": [int(least.min())], "cap": [int(high.max())]})

        if asks is None:
            asks = self.spark.createDataFrame([], "block string, at int, window int, least long, high long")
        blocks = self.blocks.select("key", "packed")
        made = blocks.groupBy("key").cogroup(asks.withColumnRenamed("block", "key").groupBy("key")).applyInPandas(attach, "key string, packed binary, asks binary, need long, cap long")
        return self.scratch.stage(made, name)

    def wave(self, asking: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            block, (least, high), shard = (pickle.loads(x.iloc[0]) for x in (left["packed"], left["asks"], right["packed"]))
            a, w, c, score = dual_search(block, shard, least, high, k, same)
            out = {"block": key[0], "at": a.astype(np.int32), "window": w.astype(np.int32), "anchor_id": block["ids"][a], "unnamed_anchor": block["unnamed"][a], "row": shard["rows"][c]}
            return pd.DataFrame(out | {"vec_id": shard["ids"][c], "unnamed": shard["unnamed"][c], "score": score})

        left = pairs.select("block", "shard").join(asking.select(F.col("key").alias("block"), "packed", "asks"), "block")
        shards = self.shards.select(F.col("key").alias("with"), "packed")
        right = pairs.select(F.col("block").alias("of"), F.col("shard").alias("with")).join(shards, "with")
        return left.groupBy("block", "shard").cogroup(right.groupBy("of", "with")).applyInPandas(meet, FOUND)

    def best(self, asking: DataFrame, windows: int, k: int, same: bool, name: str, asks: DataFrame | None) -> DataFrame:
        """Each anchor's best k in each window: FOUND with a rank."""
        if same:
            fits = (F.col("block_first") <= F.col("shard_last")) & (F.col("shard_first") <= F.col("block_last"))
        else:
            fits = (F.col("block_first") != F.col("shard_last")) | (F.col("block_last") != F.col("shard_first")) | (F.col("block_first") != F.col("block_last"))
        slack = F.greatest(F.abs("worst"), F.abs("best")) * 1e-12

        def able(needs: DataFrame) -> DataFrame:
            needs = needs.select(F.col("key").alias("block"), "need", "cap")
            reach = (F.col("best") + slack >= F.col("need").cast("double")) & (F.col("worst") - slack <= F.col("cap").cast("double"))
            return self.scratch.read("pairs").where(fits).join(needs, "block").where(reach)

        home = able(asking).groupBy("block").agg(F.max_by("shard", F.struct("best", "shard")).alias("shard"))
        home = self.scratch.stage(home, f"home-{name}")
        first = self.scratch.stage(self.wave(asking, home, k, same), f"first-{name}")
        kth = first.groupBy("block", "at", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")
        if asks is None:
            asks = kth.select("block", "at", "window", F.col("kth").alias("least"), F.lit(_NEVER).alias("high"))
        else:
            asks = asks.join(kth, ["block", "at", "window"], "left").withColumn("least", F.coalesce("kth", "least")).drop("kth")
        tighter = self.asking(asks, windows, same, f"tighter-{name}")
        others = self.scratch.stage(able(tighter).join(home, ["block", "shard"], "left_anti").select("block", "shard"), f"others-{name}")
        found = first.unionByName(self.wave(tighter, others, k, same))
        order = Window.partitionBy("block", "at", "window").orderBy(F.desc("score"), "unnamed", "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _percent(x: Column, of: int, up: bool) -> Column:
    """`of` percent of whole numbers, rounded up or down, without passing 64 bits on the way."""
    rest = F.pmod(x, F.lit(100))
    whole = F.call_function("div", x - rest, F.lit(100))
    return whole * of + F.call_function("div", rest * of + (99 if up else 0), F.lit(100))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", shard_rows: int = 1 << 16, block_rows: int = 1 << 15, leaf_rows: int = 128
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `vector_col` holds whole numbers
    (array<bigint>); `is_anchor` picks the anchors' rows; a negative's score is between `low` and `high` percent of its
    positive's."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull()) & (F.size(v) > 0), F.lit(False)) & F.col(label_col).isNotNull()
    named = F.col(id_col).cast("long")
    rows = vectors.where(fine).select(F.coalesce(named, F.lit(0)).alias("vec_id"), named.isNull().alias("unnamed"), F.col(label_col).cast("long").alias("label"), v.cast("array<bigint>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    # A row's number tells it from rows of the same id; it is fixed once it is written.
    rows = scratch.stage(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "rows")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()

    fine_level, coarse_level = _level(n, shard_rows, 16), _level(asked, block_rows, 8)
    depth = max(fine_level, coarse_level)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLED << depth).select("dim", "v").collect()
    by_dim = {d: _planes(np.array([r["v"] for r in sample if r["dim"] == d], np.float64), depth) for d in {r["dim"] for r in sample}}

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        out, dims = np.zeros(len(v), np.int64), v.map(len).to_numpy()
        for d in np.unique(dims):
            if d in by_dim:
                x, at = np.array(v[dims == d].tolist(), np.float64), np.zeros((dims == d).sum(), np.int64)
                for axis, cut in by_dim[d]:
                    at = 2 * at + (x[np.arange(len(x)), axis[at]] >= cut[at])
                out[dims == d] = at
        return pd.Series(out.astype(np.int32))

    def keyed(table: DataFrame, level: int, most: int, name: str) -> DataFrame:
        """Rows by cell; a cell of more than `most` rows makes several keys. There are at most CELLS cells a length."""
        table = scratch.stage(table.withColumn("cell", F.shiftright(cell("v"), depth - level)), name)
        parts = table.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("row"), F.col("parts"))
        return table.join(F.broadcast(parts), ["dim", "cell"]).withColumn("key", F.concat_ws("-", "dim", "cell", part)).select("key", "vec_id", "unnamed", "label", "v", "row")

    # Of equal rows of one label, an anchor's own may be one and the best k are the first k of the others.
    copies = Window.partitionBy("dim", "label", "v").orderBy("unnamed", "vec_id", "row")
    first = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy")
    shards = keyed(first, fine_level, shard_rows, "candidates").groupBy("key").applyInPandas(_built(leaf_rows), _TREE)
    blocks = keyed(scratch.read("rows").where("asks"), coarse_level, block_rows, "anchors").groupBy("key").applyInPandas(_built(leaf_rows // 2), _TREE)
    search = _Search(scratch, shards, blocks)

    near = search.best(search.asking(None, 1, True, "open"), 1, positives, True, "positives", None)
    near = scratch.stage(near.select("block", "at", (F.col("rank") - 1).alias("window"), "anchor_id", "unnamed_anchor", F.col("vec_id").alias("positive_id"), F.col("unnamed").alias("unnamed_positive"), F.col("score").alias("positive_score")), "positives")
    lower, upper = _percent(F.col("positive_score"), low, True), _percent(F.col("positive_score"), high, False)
    asks = scratch.stage(near.select("block", "at", "window", lower.alias("least"), upper.alias("high")).where("least <= high"), "asks")
    found = search.best(search.asking(asks, positives, False, "windows"), positives, negatives, False, "negatives", asks)

    found = found.select("block", "at", "window", "rank", F.col("vec_id").alias("negative_id"), "unnamed", F.col("score").alias("negative_score"))
    both = scratch.read("positives").join(found, ["block", "at", "window"])
    hidden = lambda flag, c: F.when(~F.col(flag), F.col(c)).alias(c)
    return both.select(hidden("unnamed_anchor", "anchor_id"), hidden("unnamed_positive", "positive_id"), "rank", hidden("unnamed", "negative_id"), "positive_score", "negative_score")
