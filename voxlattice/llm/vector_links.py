"""Near-duplicate vectors by cosine: int8 tile products with rigorous error bounds.

Equal vectors are first folded into one class (grouped with partial sums, so a vector that a third of all rows hold is
one row afterwards). Classes are cut into tiles of nearby vectors; two tiles meet in one task only if the angle between
their centres leaves room for a link. There the unit vectors, rounded to 127ths (int8), are multiplied as whole tiles;
each vector's exact rounding error bounds how far such a product can be off, and only pairs that may reach the
threshold are computed again in double precision. A task returns each class's number of links and a spanning forest of
its links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; equal rows are separate vectors that link; an empty table gives no rows; extra columns
are ignored. A null id is returned as it is, and never stands for a component; rows of one id with different vectors are
linked each by its own vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket
from .components import components

#: Centres that tiles form around: a bounded sample, which only decides how tight tiles are.
CENTRES = 64


def sound(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(1, keepdims=True)  # the squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1))[:, None]


class Tile:
    """Unit vectors as int8, and how far a product with each can be off."""

    def __init__(self, vectors):
        self.unit = _unit(vectors)
        self.int8 = np.rint(self.unit * 127).astype(np.int8)
        self.error = np.sqrt(((self.unit - self.int8 / 127.0) ** 2).sum(1)) * (1 + 1e-12)
        # Sums of products of int8 are whole numbers, which float32 holds exactly up to 2**24.
        self.exact = np.float32 if self.int8.shape[1] * 127 * 127 < 1 << 24 else np.float64

    def near(self, other: "Tile", threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs with a cosine of at least `threshold`."""
        product = self.int8.astype(self.exact) @ other.int8.astype(self.exact).T
        # |u.v - u8.v8| <= |u||ev| + |eu||v8|, and |v8| <= 1 + |ev|; the last term is for rounding in double.
        most = self.error.max() * (1 + other.error.max()) + other.error.max()
        i, j = np.nonzero(product >= (threshold - most - 1e-9) * 127 * 127)
        room = self.error[i] * (1 + other.error[j]) + other.error[j] + 1e-9
        near = product[i, j] >= (threshold - room) * 127 * 127
        i, j = i[near], j[near]
        keep = [np.einsum("ij,ij->i", self.unit[i[k : k + 65536]], other.unit[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return i[keep], j[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a, b), those that join two trees."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def vector_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("fit", sound(F.col("v")) & F.exists("v", lambda x: x != 0))
    classes = rows.where("fit").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # A class is a node of its own, whatever its rows' ids; its number is fixed once it is written.
    classes = scratch.stage(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")

    centres = classes.orderBy(F.xxhash64("v"), "v").limit(CENTRES).select("dim", "v").collect()
    by_dim = {d: _unit([r["v"] for r in centres if r["dim"] == d]) for d in {r["dim"] for r in centres}}

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        dims = v.map(len).to_numpy()
        for d in np.unique(dims):
            if d in by_dim:
                out[dims == d] = (_unit(v[dims == d].tolist()) @ by_dim[d].T).argmax(1)
        return pd.Series(out)

    counted = classes.withColumn("cell", cell("v"))
    sizes = counted.groupBy("dim", "cell").count()
    # A cell of many rows makes several tiles; the number of tiles of all is rows / tile_rows + centres at most.
    counted = counted.join(F.broadcast(sizes.withColumn("parts", F.ceil(F.col("count") / tile_rows).cast("int")).drop("count")), ["dim", "cell"])
    tile = F.concat_ws("-", "dim", "cell", F.pmod(F.col("class"), F.col("parts")))
    tiled = scratch.stage(counted.withColumn("tile", tile).select("dim", "tile", "class", "copies", "v"), "tiled")

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(part["v"].tolist())
        centre = unit.sum(0)
        centre = centre / np.sqrt((centre**2).sum()) if (centre**2).sum() > 0 else unit[0]
        spread = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "tile": [part["tile"].iloc[0]], "centre": [centre.tolist()], "spread": [spread]})

    tiles = scratch.stage(tiled.groupBy("tile").applyInPandas(summary, "dim int, tile string, centre array<double>, spread double"), "tiles")
    other = tiles.select("dim", *[F.col(c).alias(f"{c}2") for c in ("tile", "centre", "spread")])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("centre", "centre2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))
    meet = tiles.join(other, "dim").where((F.col("tile") <= F.col("tile2")) & (angle <= F.col("spread") + F.col("spread2") + float(np.arccos(threshold)) + 1e-6))
    meet = scratch.stage(meet.select("tile", "tile2", F.concat_ws(" ", "tile", "tile2").alias("pair")), "meet")

    def product(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links of one tile with another or, where there is no right side, with itself."""
        same = key[0].split(" ")[0] == key[0].split(" ")[1]
        right = left if same else right
        a, b = Tile(left["v"].tolist()), Tile(right["v"].tolist())
        i, j = a.near(b, threshold)
        if same:
            i, j = i[i < j], j[i < j]
        at_left = np.bincount(i, right["copies"].to_numpy()[j], len(left))
        at_right = np.bincount(j, left["copies"].to_numpy()[i], len(right))
        ids_a, ids_b = left["class"].to_numpy(), right["class"].to_numpy()
        links = np.concatenate([at_left, at_right]).astype(np.int64)
        ids = np.concatenate([ids_a, ids_b])
        tree = _forest(ids_a[i], ids_b[j])
        known = links > 0
        return pd.DataFrame(
            {
                "class": pd.array([*ids[known].tolist(), *[None] * len(tree)], "Int64"),
                "links": pd.array([*links[known].tolist(), *[None] * len(tree)], "Int64"),
                "a": pd.array([*[None] * int(known.sum()), *[x for x, _ in tree]], "Int64"),
                "b": pd.array([*[None] * int(known.sum()), *[y for _, y in tree]], "Int64"),
            }
        )

    slim = ("tile", "class", "copies", "v")
    left = meet.select("tile", "pair").join(tiled.select(*slim), "tile")
    right = scratch.read("meet").where("tile != tile2").select(F.col("tile2").alias("tile"), "pair").join(scratch.read("tiled").select(*slim), "tile")
    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(product, "class long, links long, a long, b long")
    found = scratch.stage(found, "found")

    named = components(found.where("a is not null").select("a", "b"), scratch)
    per_class = found.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "v", "low", "copies").join(per_class, "class", "left")
    known = known.join(named, known["class"] == named["node"], "left").withColumn("component", F.coalesce("component", "class"))
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(least, "component").select(
        F.col("v").alias("of"),
        (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    fit = rows.where("fit").join(known, F.col("v") == F.col("of")).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fit.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
