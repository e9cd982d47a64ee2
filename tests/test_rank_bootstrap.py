"""Rank bootstraps against drawing the rows."""

import numpy as np
import pytest

from voxlattice.operators import rank_bootstrap as R


def ranks(x):
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def correlation(a, b):
    return np.corrcoef(a, b)[0, 1] if np.ptp(a) and np.ptp(b) else np.nan


def test_draws_equal_drawn_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{rng.integers(7)}", float(rng.integers(1, 9)), float(rng.integers(1, 30)), round(float(rng.normal()), 1)) for _ in range(400)]
    rows += [("hot", 3.0, 5.0, 0.1)] * 200 + [("hot", None, 5.0, 0.1), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cluster string, truth double, pred double, pred2 double").repartition(5)
    clean = [r for r in rows if None not in r]
    names = sorted({r[0] for r in clean})
    numbers = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "cluster string, c int")
    sizes, single, cubes = R.rank_forms(df.dropna().join(numbers, "cluster").selectExpr("c", "truth t", "pred p", "pred2 q"), len(names))
    m = rng.integers(0, 4, (20, len(names))).astype(float)
    m[0] = 0
    m[0, names.index("hot")] = 3  # no spread
    got = R.spearman_deltas(m, sizes, single, cubes)
    assert np.isnan(got[0])
    for own, delta in zip(m[1:], got[1:], strict=True):
        drawn = np.array([r[1:] for r in clean for _ in range(int(own[names.index(r[0])]))])
        t, p, q = (ranks(drawn[:, k]) for k in range(3))
        assert delta == pytest.approx(correlation(p, t) - correlation(q, t), abs=1e-9)
    told = R.cluster_correlations(df, 50, "s").toPandas()
    assert len(told) == 50 and told["delta_pearson"].notna().all() and told["delta_spearman"].abs().max() < 2
    assert R.cluster_correlations(df.limit(0), 50, "s").count() == 0


def test_many_clusters_are_refused(spark):
    df = spark.range(300).selectExpr("id as cluster", "cast(id as double) truth", "cast(id as double) pred", "cast(id as double) pred2")
    with pytest.raises(ValueError, match="clusters"):
        R.cluster_correlations(df, 10, "s")
