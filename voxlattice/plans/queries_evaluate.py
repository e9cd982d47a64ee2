"""Queries of evaluation analytics over the scored manifest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.functions.columns import average_rank, pearson
from voxlattice.operators import evaluate as E
from voxlattice.operators.evaluate import r6
from voxlattice.operators.order_statistics import order_statistics
from voxlattice.operators.rank_bootstrap import cluster_correlations
from voxlattice.session import staged
from voxlattice.sources.lenses import MANIFEST, manifest, read

_METRICS = """count(*) as n, round(sqrt(avg(({p} - truth) * ({p} - truth))), 6) as rmse, round(avg(abs({p} - truth)), 6) as mae,
  round(avg({p} - truth), 6) as bias, round(coalesce(covar_pop({p}, truth) / nullif(stddev_pop({p}) * stddev_pop(truth), 0), 0), 6) as pearson"""


def _metrics(p: str = "pred") -> str:
    return _METRICS.format(p=p)


_CONDITIONS = "c as (select family, condition, avg(truth) as truth, avg(pred) as pred, avg(pred2) as pred2 from m group by family, condition)"
_POS = "q as (select *, row_number() over (order by family, condition) - 1 as pos, count(*) over () as n from c)"
_DRAW = "cast('0x' || substr(md5('{seed}-' || b.turn || '-' || {no}), 1, 8) as bigint) % {n}"


def eval_utterance_metrics(spark, d):
    return manifest(spark, d).agg(*E.metrics())


def eval_by_family(spark, d):
    return E.by(manifest(spark, d), "family")


def eval_by_condition(spark, d):
    """Two levels: means of each condition, then metrics over conditions."""
    return E.by(E.condition_means(manifest(spark, d), "family", "condition"), "family")


def eval_condition_key_variant(spark, d):
    both = E.condition_means(manifest(spark, d), "family", "condition").agg(*E.metrics()).withColumn("key", F.lit("family+condition"))
    one = E.condition_means(manifest(spark, d), "condition").agg(*E.metrics()).withColumn("key", F.lit("condition"))
    return both.unionByName(one)


def avg_ranks(spark, d):
    means = E.condition_means(manifest(spark, d), "family", "condition").withColumn("score", F.round("pred", 1))
    rank = average_rank("score", W.partitionBy("family").orderBy("score"), W.partitionBy("family", "score"))
    return means.select("family", "condition", rank.alias("rank"))


def spearman_by_family(spark, d):
    return E.spearman(manifest(spark, d), "family")


def grouping_sets_report(spark, d):
    """Sums per family, per condition and over all, in one pass."""
    rows = manifest(spark, d).groupingSets([["family"], ["condition"], []], "family", "condition")
    return rows.agg(*E.metrics(), F.grouping_id().cast("int").alias("level")).select("family", "condition", "level", "n", "rmse", "mae", "bias", "pearson")


def multi_baseline_unpivot(spark, d):
    rows = manifest(spark, d).unpivot(["row_id", "family", "truth"], ["pred", "pred2"], "predictor", "score")
    return E.by(rows, "predictor", pred="score")


def worst_residuals_topk(spark, d):
    return E.worst(manifest(spark, d), 25)


def mapped_rmse_linear(spark, d):
    rows = manifest(spark, d)
    line = rows.groupBy("family").agg(F.coalesce(F.regr_slope("truth", "pred"), F.lit(0.0)).alias("a"), F.coalesce(F.regr_intercept("truth", "pred"), F.avg("truth")).alias("b"))
    error = F.col("a") * F.col("pred") + F.col("b") - F.col("truth")
    return rows.join(line, "family").groupBy("family").agg(r6(F.sqrt(F.avg(error * error))).alias("mapped_rmse"))


def mapped_rmse_cubic(spark, d):
    rows = manifest(spark, d)
    sums = E.polynomial_sums(rows, 3).first()
    matrix = np.array([[sums[f"s{i + j}"] for j in range(4)] for i in range(4)]) + 1e-9 * np.eye(4)
    w = np.linalg.lstsq(matrix, np.array([sums[f"t{i}"] for i in range(4)]), rcond=None)[0]
    value = sum((F.lit(float(c)) * F.pow("pred", F.lit(k)) for k, c in enumerate(w)), F.lit(0.0))
    error = value - F.col("truth")
    return rows.agg(F.round(F.sqrt(F.avg(error * error)), 4).alias("mapped_rmse"))


def _conditions(spark, d):
    means = E.condition_means(manifest(spark, d), "family", "condition")
    return means.withColumn("pos", (F.row_number().over(W.orderBy("family", "condition")) - 1).cast("long"))


def row_bootstrap_delta_ci(spark, d):
    return E.interval(E.row_bootstrap(_conditions(spark, d), 200, "row"))


def cluster_bootstrap_ci(spark, d):
    return E.interval(E.cluster_bootstrap(manifest(spark, d), 200, "cluster"))


def _correlation_intervals(spark, d, turns):
    deltas = staged(cluster_correlations(manifest(spark, d), turns, "cluster"), "deltas")
    measured = deltas.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"delta_{c}").alias("v")) for c in ("pearson", "spearman")])).alias("m")).select("m.*")
    told = measured.where("v is not null").groupBy("measure").agg(F.count("*").alias("draws"), r6(F.avg("v")).alias("mean_delta"))
    places = order_statistics(measured, ["measure"], "v", {"low": 0.025, "high": 0.975})
    return told.join(places, "measure").select("measure", "draws", "mean_delta", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


def cluster_bootstrap_correlations(spark, d):
    """Pearson and Spearman deltas of 200 draws: what SQL can follow."""
    return _correlation_intervals(spark, d, 200)


def cluster_bootstrap_report(spark, d):
    """Pearson and Spearman deltas of 10,000 draws."""
    return _correlation_intervals(spark, d, 10_000)


def noninferiority_verdict(spark, d):
    limits = E.interval(E.row_bootstrap(_conditions(spark, d), 200, "row"))
    return limits.select("high", F.lit(0.1).alias("margin"), (F.col("high") < 0.1).alias("noninferior"))


def null_aware_pairs(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("n_scored"), r6(F.avg("quality")).alias("mean_quality"))


def paired_correlation_delta(spark, d):
    """Both predictors on the rows that have the benchmark (here: an even row id)."""
    rows = manifest(spark, d).where("row_id % 2 = 0")
    p, q, t = F.col("pred"), F.col("pred2"), F.col("truth")
    return rows.groupBy("family").agg(F.count("*").alias("n"), r6(pearson(p, t) - pearson(q, t)).alias("delta"))


def _cases(spark, d):
    """A family's sweep: the mean score at each level."""
    return manifest(spark, d).groupBy("family", F.floor(F.col("condition") / 5).cast("long").alias("level")).agg(F.avg("pred").alias("mos"))


def monotonicity_report(spark, d):
    return E.monotonicity(_cases(spark, d), 0.05)


def engineering_gates(spark, d):
    report = E.monotonicity(_cases(spark, d), 0.05).agg(F.max("rho").alias("worst_rho"), F.sum("reversals").alias("reversals"))
    ranges = manifest(spark, d).agg(F.min("pred").alias("low"), F.max("pred").alias("high"))
    gates = F.array(
        F.struct(F.lit("rho").alias("gate"), r6(F.col("worst_rho")).alias("value"), (F.col("worst_rho") <= -0.2).alias("passed")),
        F.struct(F.lit("reversals").alias("gate"), F.col("reversals").cast("double").alias("value"), (F.col("reversals") == 0).alias("passed")),
        F.struct(F.lit("range_low").alias("gate"), r6(F.col("low")).alias("value"), (F.col("low") >= 1).alias("passed")),
        F.struct(F.lit("range_high").alias("gate"), r6(F.col("high")).alias("value"), (F.col("high") <= 5).alias("passed")),
    )
    return report.join(ranges).select(F.explode(gates).alias("g")).select("g.*")


def suite_summary(spark, d):
    rows = _cases(spark, d)
    clean = rows.where("level = 0").agg(F.avg("mos").alias("clean"))
    return rows.join(F.broadcast(clean)).groupBy("family").agg(F.count("*").alias("cases"), r6(F.max(F.abs(F.col("mos") - F.col("clean")))).alias("most"), r6(F.min("mos")).alias("low"), r6(F.max("mos")).alias("high"))


QUERIES = {f.__name__: f for f in (
    eval_utterance_metrics, eval_by_family, eval_by_condition, eval_condition_key_variant, avg_ranks, spearman_by_family, grouping_sets_report,
    multi_baseline_unpivot, worst_residuals_topk, mapped_rmse_linear, mapped_rmse_cubic, row_bootstrap_delta_ci, cluster_bootstrap_ci, cluster_bootstrap_correlations, cluster_bootstrap_report,
    noninferiority_verdict, null_aware_pairs, paired_correlation_delta, monotonicity_report, engineering_gates, suite_summary,
)}

_CASES = "k as (select family, cast(floor(condition / 5) as bigint) as level, avg(pred) as mos from m group by all)"
_REPORT = f"""{_CASES},
k2 as (select *, coalesce(cast(mos - lag(mos) over (partition by family order by level) > 0.05 as int), 0) as rise,
    rank() over (partition by family order by level) + (count(*) over (partition by family, level) - 1) / 2e0 as rl,
    rank() over (partition by family order by mos) + (count(*) over (partition by family, mos) - 1) / 2e0 as rm from k),
r as (select family, count(*) as n, round(coalesce(covar_pop(rl, rm) / nullif(stddev_pop(rl) * stddev_pop(rm), 0), 0), 6) as rho,
    cast(sum(rise) as bigint) as reversals from k2 group by family)"""
_ROWS = f"""{_CONDITIONS}, {_POS}, turns as (select unnest(range(200)) as turn),
drawn as (select b.turn, {_DRAW.format(seed='row', no='q.pos', n='q.n')} as pos from turns b, q),
delta as (select turn, sqrt(avg((pred - truth) * (pred - truth))) - sqrt(avg((pred2 - truth) * (pred2 - truth))) as delta
  from drawn join q using (pos) group by turn),
ci as (select round(avg(delta), 6) as mean_delta, round(list_sort(list(delta))[cast(floor(0.025 * 199) as int) + 1], 6) as low,
  round(list_sort(list(delta))[cast(floor(0.975 * 199) as int) + 1], 6) as high from delta)"""

SQL = {
    "eval_utterance_metrics": f"with {MANIFEST} select {_metrics()} from m",
    "eval_by_family": f"with {MANIFEST} select family, {_metrics()} from m group by family",
    "eval_by_condition": f"with {MANIFEST}, {_CONDITIONS} select family, {_metrics()} from c group by family",
    "eval_condition_key_variant": f"""with {MANIFEST}, {_CONDITIONS}, d as (select avg(truth) as truth, avg(pred) as pred from m group by condition)
        select 'family+condition' as key, {_metrics()} from c union all select 'condition' as key, {_metrics()} from d""",
    "avg_ranks": f"""with {MANIFEST}, {_CONDITIONS}, s as (select *, round(pred, 1) as score from c)
        select family, condition, rank() over (partition by family order by score) + (count(*) over (partition by family, score) - 1) / 2e0 as rank from s""",
    "spearman_by_family": f"""with {MANIFEST}, r as (
        select family, rank() over (partition by family order by pred) + (count(*) over (partition by family, pred) - 1) / 2e0 as x,
          rank() over (partition by family order by truth) + (count(*) over (partition by family, truth) - 1) / 2e0 as y from m)
        select family, count(*) as n, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) as spearman from r group by family""",
    "grouping_sets_report": f"with {MANIFEST} select family, condition, cast(grouping(family, condition) as integer) as level, {_metrics()} from m group by grouping sets ((family), (condition), ())",
    "multi_baseline_unpivot": f"""with {MANIFEST}, u as (select 'pred' as predictor, pred as score, truth from m union all select 'pred2', pred2, truth from m)
        select predictor, {_metrics('score')} from u group by predictor""",
    "worst_residuals_topk": f"""with {MANIFEST} select row_id, family, condition, round(pred - truth, 6) as error from m
        order by round(abs(pred - truth), 6) desc, row_id, family, condition, error limit 25""",
    "mapped_rmse_linear": f"""with {MANIFEST}, l as (select family, regr_slope(truth, pred) as a, regr_intercept(truth, pred) as b from m group by family)
        select m.family, round(sqrt(avg((a * pred + b - truth) * (a * pred + b - truth))), 6) as mapped_rmse from m join l on m.family = l.family group by m.family""",
    "row_bootstrap_delta_ci": f"with {MANIFEST}, {_ROWS} select * from ci",
    "noninferiority_verdict": f"with {MANIFEST}, {_ROWS} select high, 0.1e0 as margin, high < 0.1 as noninferior from ci",
    "cluster_bootstrap_ci": f"""with {MANIFEST}, g as (
        select cluster, count(*) as n, sum(truth) as t, sum(pred) as p, sum(pred2) as q, sum(truth * truth) as tt, sum(pred * pred) as pp,
          sum(pred2 * pred2) as qq, sum(truth * pred) as tp, sum(truth * pred2) as tq from m group by cluster),
        g2 as (select *, row_number() over (order by cluster) - 1 as pos, count(*) over () as clusters from g), turns as (select unnest(range(200)) as turn),
        drawn as (select b.turn, {_DRAW.format(seed='cluster', no='g2.pos', n='g2.clusters')} as pos from turns b, g2),
        s as (select turn, sum(n) as n, sum(t) as t, sum(p) as p, sum(q) as q, sum(tt) as tt, sum(pp) as pp, sum(qq) as qq, sum(tp) as tp, sum(tq) as tq
          from drawn join g2 using (pos) group by turn),
        delta as (select (n * tp - t * p) / sqrt((n * tt - t * t) * (n * pp - p * p)) - (n * tq - t * q) / sqrt((n * tt - t * t) * (n * qq - q * q)) as delta from s)
        select round(avg(delta), 6) as mean_delta, round(list_sort(list(delta))[cast(floor(0.025 * 199) as int) + 1], 6) as low,
          round(list_sort(list(delta))[cast(floor(0.975 * 199) as int) + 1], 6) as high from delta""",
    "cluster_bootstrap_correlations": f"""with {MANIFEST}, g as (select cluster, row_number() over (order by cluster) - 1 as pos, count(*) over () as clusters from (select distinct cluster from m)),
        drawn as (select b.turn, {_DRAW.format(seed='cluster', no='g.pos', n='g.clusters')} as pos from (select unnest(range(200)) as turn) b, g),
        times as (select turn, cluster, cast(count(*) as double) as w from drawn join g using (pos) group by all),
        r as (select turn, w, truth as t, pred as p, pred2 as q from times join m using (cluster)),
        k as (select turn, w, t, p, q, """ + ", ".join(f"sum(w) over (partition by turn order by {x} range between unbounded preceding and current row) - sum(w) over (partition by turn, {x}) / 2 + 0.5e0 as r{x}" for x in "tpq") + """ from r),
        s as (select turn, sum(w) as n, """ + ", ".join(f"sum(w * {f}{x}) as {f}{x}, sum(w * {f}{x} * {f}{y}) as {f}{x}{y}" if x == y else f"sum(w * {f}{x} * {f}{y}) as {f}{x}{y}" for f in ("", "r") for x, y in ("tt", "pp", "qq", "tp", "tq")) + """ from k group by turn),
        d as (select turn, """ + ", ".join("(n * {0}tp - {0}t * {0}p) / sqrt((n * {0}tt - {0}t * {0}t) * (n * {0}pp - {0}p * {0}p)) - (n * {0}tq - {0}t * {0}q) / sqrt((n * {0}tt - {0}t * {0}t) * (n * {0}qq - {0}q * {0}q)) as {1}".format(f, n) for f, n in (("", "pearson"), ("r", "spearman"))) + """ from s),
        u as (select 'pearson' as measure, pearson as v from d union all select 'spearman', spearman from d)
        select measure, count(*) as draws, round(avg(v), 6) as mean_delta, round(list_sort(list(v))[cast(floor(0.025 * (count(*) - 1)) as int) + 1], 6) as low,
          round(list_sort(list(v))[cast(floor(0.975 * (count(*) - 1)) as int) + 1], 6) as high from u where isfinite(v) group by measure""",
    "null_aware_pairs": """select lang, count(*) as n, count(quality) as n_scored, round(avg(quality), 6) as mean_quality
        from documents left join labels using (doc_id) group by lang""",
    "paired_correlation_delta": f"""with {MANIFEST} select family, count(*) as n, round(covar_pop(pred, truth) / (stddev_pop(pred) * stddev_pop(truth))
        - covar_pop(pred2, truth) / (stddev_pop(pred2) * stddev_pop(truth)), 6) as delta from m where row_id % 2 = 0 group by family""",
    "monotonicity_report": f"with {MANIFEST}, {_REPORT} select * from r",
    "engineering_gates": f"""with {MANIFEST}, {_REPORT}, w as (select max(rho) as rho, sum(reversals) as v from r), z as (select min(pred) as lo, max(pred) as hi from m)
        select 'rho' as gate, round(rho, 6) as value, rho <= -0.2 as passed from w union all select 'reversals', cast(v as double), v = 0 from w
        union all select 'range_low', round(lo, 6), lo >= 1 from z union all select 'range_high', round(hi, 6), hi <= 5 from z""",
    "suite_summary": f"""with {MANIFEST}, {_CASES}, z as (select avg(mos) as clean from k where level = 0)
        select family, count(*) as cases, round(max(abs(mos - clean)), 6) as most, round(min(mos), 6) as low, round(max(mos), 6) as high from k, z group by family""",
}
