"""Connected components by alternating stars: each node hooks its larger neighbours, then its smaller ones, to the
smallest neighbour it knows. Only minima are grouped, and hubs are joined (which adaptive execution can split), so no
task needs all neighbours of a node. Every round is staged; rounds grow with the logarithm of the longest chain."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links of a staged file: few links make few files, however many partitions a shuffle has.
ROWS_A_FILE = 100_000


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """Edges (a, b) of long ids -> (node, component): the smallest id reachable, for each node that is not its own."""

    def hook(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    stars = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, seen, turn = scratch.stage(stars, f"{name}0"), None, 0
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        files = ceil(state[0] / ROWS_A_FILE)
        # Sums that agree are a hint; the links themselves decide.
        if not state[0] or state == seen and not stars.join(past, ["u", "v"], "left_anti").limit(1).count():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, past, turn = state, scratch.read(f"{name}{turn}"), turn + 1
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(hook(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = scratch.stage(large.coalesce(2 * files), f"{name}{turn}large")
        small = large.join(hook(large), "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        stars = scratch.stage(small.distinct().coalesce(files), f"{name}{turn}")
        if turn > 1:
            scratch.drop(f"{name}{turn - 2}")
        scratch.drop(f"{name}{turn}large")
