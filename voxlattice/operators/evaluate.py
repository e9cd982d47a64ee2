"""Evaluation of scored manifests: errors, ranks, roll-ups, bootstraps, verdicts. Everything reduces to moments that
are summed before any shuffle; rows are ranked by distinct value, so no window holds a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.functions.columns import average_rank, bias, draw, mae, pearson, quantile_floor, rmse


def r6(x: Column) -> Column:
    return F.round(x, 6)


def metrics(pred: str = "pred", truth: str = "truth") -> list[Column]:
    p, t = F.col(pred), F.col(truth)
    return [F.count("*").alias("n"), r6(rmse(p, t)).alias("rmse"), r6(mae(p, t)).alias("mae"), r6(bias(p, t)).alias("bias"), r6(pearson(p, t)).alias("pearson")]


def by(rows: DataFrame, *keys: str, pred: str = "pred") -> DataFrame:
    return rows.groupBy(*keys).agg(*metrics(pred))


def condition_means(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("truth", "pred", "pred2")])


def ranks(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, value, n, rank: average ranks from the counts of distinct values."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("rank", before + (F.col("n") + 1) / F.lit(2.0))


def spearman(rows: DataFrame, *keys: str, pred: str = "pred", truth: str = "truth") -> DataFrame:
    a = ranks(rows, pred, *keys).select(*keys, pred, F.col("rank").alias("rank_p"))
    b = ranks(rows, truth, *keys).select(*keys, truth, F.col("rank").alias("rank_t"))
    ranked = rows.select(*keys, pred, truth).join(a, [*keys, pred]).join(b, [*keys, truth])
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), r6(pearson(F.col("rank_p"), F.col("rank_t"))).alias("spearman"))


def worst(rows: DataFrame, k: int) -> DataFrame:
    error = F.col("pred") - F.col("truth")
    out = rows.withColumn("error", r6(error)).withColumn("gap", r6(F.abs(error)))
    return out.orderBy(F.desc("gap"), "row_id", "family", "condition", "error").limit(k).select("row_id", "family", "condition", "error")


def row_bootstrap(rows: DataFrame, turns: int, seed: str) -> DataFrame:
    """turn, delta: RMSE of pred minus RMSE of pred2 over as many drawn rows. rows: pos (0-based), truth, pred, pred2."""
    n = rows.agg(F.count("*").cast("long").alias("n"))
    turn = rows.sparkSession.range(turns).select(F.col("id").alias("turn"))
    spine = rows.select(F.col("pos").alias("draw_no"))
    drawn = turn.join(F.broadcast(n)).join(spine).withColumn("pos", draw(F.col("n"), F.lit(seed), F.col("turn"), F.col("draw_no")))
    got = drawn.select("turn", "pos").join(rows, "pos")
    return got.groupBy("turn").agg((rmse(F.col("pred"), F.col("truth")) - rmse(F.col("pred2"), F.col("truth"))).alias("delta"))


def interval(deltas: DataFrame) -> DataFrame:
    values = F.collect_list("delta")
    return deltas.agg(r6(F.avg("delta")).alias("mean_delta"), r6(quantile_floor(values, 0.025)).alias("low"), r6(quantile_floor(values, 0.975)).alias("high"))


def cluster_bootstrap(rows: DataFrame, turns: int, seed: str) -> DataFrame:
    """turn, delta: Pearson of pred minus Pearson of pred2 over whole clusters drawn with replacement. A cluster enters
    by its moments, so a turn costs one row a cluster, whatever the clusters hold."""
    t, p, q = F.col("truth"), F.col("pred"), F.col("pred2")
    parts = {"n": F.lit(1.0), "t": t, "p": p, "q": q, "tt": t * t, "pp": p * p, "qq": q * q, "tp": t * p, "tq": t * q}
    moments = rows.groupBy("cluster").agg(*[F.sum(x).alias(c) for c, x in parts.items()])
    moments = moments.withColumn("pos", (F.row_number().over(W.orderBy("cluster")) - 1).cast("long"))
    n = moments.agg(F.count("*").cast("long").alias("clusters"))
    turn = rows.sparkSession.range(turns).select(F.col("id").alias("turn"))
    drawn = turn.join(F.broadcast(n)).join(moments.select(F.col("pos").alias("draw_no")))
    drawn = drawn.select("turn", draw(F.col("clusters"), F.lit(seed), F.col("turn"), F.col("draw_no")).alias("pos")).join(moments, "pos")
    sums = drawn.groupBy("turn").agg(*[F.sum(c).alias(c) for c in parts])

    def r(x: str) -> Column:
        above = F.col("n") * F.col(f"t{x}") - F.col("t") * F.col(x)
        spread = (F.col("n") * F.col("tt") - F.col("t") * F.col("t")) * (F.col("n") * F.col(f"{x}{x}") - F.col(x) * F.col(x))
        return F.coalesce(F.try_divide(above, F.when(spread > 0, F.sqrt(spread))), F.lit(0.0))

    return sums.select("turn", (r("p") - r("q")).alias("delta"))


def monotonicity(cases: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """family, n, rho, reversals: Spearman of level and score, and rises of the score from level to level."""
    step = W.partitionBy("family").orderBy("level")
    rise = F.coalesce((F.col("mos") - F.lag("mos").over(step) > tolerance).cast("int"), F.lit(0))
    marked = cases.withColumn("rise", rise)
    for c in ("level", "mos"):
        marked = marked.withColumn(f"rank_{c}", average_rank(c, W.partitionBy("family").orderBy(c), W.partitionBy("family", c)))
    return marked.groupBy("family").agg(F.count("*").alias("n"), r6(pearson(F.col("rank_level"), F.col("rank_mos"))).alias("rho"), F.sum("rise").cast("long").alias("reversals"))


def polynomial_sums(rows: DataFrame, degree: int) -> DataFrame:
    """Power sums that a polynomial fit of truth on pred needs: one row, however many rows there are."""
    x, y = F.col("pred"), F.col("truth")
    powers = [F.sum(F.pow(x, F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)]
    return rows.agg(*powers, *[F.sum(F.pow(x, F.lit(k)) * y).alias(f"t{k}") for k in range(degree + 1)])
