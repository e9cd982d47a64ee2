"""Fits over distributed rows against plain descent over all rows at once."""

import numpy as np
import pytest

from voxlattice.operators import fit


def _plain(x, y, epochs, rate, l2, decay, every):
    w, b = np.full(x.shape[1], 0.5), 0.02
    for epoch in range(epochs):
        raw = 5 - b - x @ w
        error = np.where((raw > 1) & (raw < 5), raw - y, 0) / len(y)
        step = rate * decay ** (max(0, epoch - 1) // every)
        w, b = np.maximum(0, w + step * (2 * x.T @ error - 2 * l2 * w)), max(0.0, b + step * 2 * error.sum())
    return np.append(w, b)


def _data(n, clipped):
    rng = np.random.default_rng(n)
    x = rng.random((n, 5)) * (3 if clipped else 1)
    x[: n // 10] = 0  # nothing but the bias decides on these
    return x, np.clip(5 - 0.1 - x @ [1.4, 0.9, 0.0, 0.3, 0.6] + rng.normal(0, 0.4, n), 1, 5)


def _rows(spark, x, y, split=None):
    named = ", ".join(f"f{i} double" for i in range(x.shape[1]))
    split = split or ["train"] * len(y)
    return spark.createDataFrame([(*map(float, a), float(b), s) for a, b, s in zip(x, y, split, strict=True)], f"{named}, mos double, split string")


@pytest.mark.parametrize("near", [8, 64, 4096])
def test_blocks_of_epochs_equal_descent_over_all_rows(spark, near):
    x, y = _data(900, clipped=True)
    features, penalties = [f"f{i}" for i in range(5)], [0.0, 0.002, 0.1]
    rows = _rows(spark, x, y).repartition(5)
    epochs = 15 if near == 8 else 300
    got = fit.fit_grid(rows, features, "mos", penalties, epochs, 0.03, every=100, near=near, all_rows=True).collect()
    for r in got:
        expected = _plain(x, y, epochs, 0.03, r["l2"], 0.7, 100)
        assert r["weights"] == pytest.approx(expected.tolist(), abs=1e-9)
        estimate = np.clip(5 - expected[-1] - x @ expected[:-1], 1, 5)
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean((estimate - y) ** 2)), abs=1e-9)
        assert r["pearson"] == pytest.approx(np.corrcoef(estimate, y)[0, 1], abs=1e-9)
        assert r["bias"] == pytest.approx(np.mean(estimate - y), abs=1e-9)


def test_a_tree_of_partial_sums_gives_the_same_weights(spark):
    x, y = _data(700, clipped=False)
    features = [f"f{i}" for i in range(5)]
    rows = _rows(spark, x, y)
    parts = rows.repartition(90)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        got = fit.fit_grid(parts, features, "mos", [0.002], 40, 0.03, every=15, near=40, all_rows=True).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got["weights"] == pytest.approx(_plain(x, y, 40, 0.03, 0.002, 0.7, 15).tolist(), abs=1e-9)


def test_figures_are_those_of_dev_and_odd_rows_are_left_out(spark):
    x, y = _data(60, clipped=False)
    split = ["dev" if i % 3 == 0 else "train" for i in range(60)]
    features, train = [f"f{i}" for i in range(5)], np.arange(60) % 3 > 0
    rows = _rows(spark, x, y, split)
    odd = spark.createDataFrame([(None, 0.1, 0.1, 0.1, 0.1, 3.0, "train"), (float("nan"), 0.1, 0.1, 0.1, 0.1, 3.0, "train"), (0.1, 0.1, 0.1, 0.1, 0.1, None, "dev")], rows.schema)
    got = fit.fit_grid(rows.unionByName(odd), features, "mos", [0.01], 50, 0.03).first()
    w = _plain(x[train], y[train], 50, 0.03, 0.01, 0.7, 3000)
    assert got["weights"] == pytest.approx(w.tolist(), abs=1e-9)
    estimate = np.clip(5 - w[-1] - x[~train] @ w[:-1], 1, 5)
    assert got["rmse"] == pytest.approx(np.sqrt(np.mean((estimate - y[~train]) ** 2)), abs=1e-9)
    no_dev = fit.fit_grid(rows.where("split = 'train'"), features, "mos", [0.01], 5, 0.03).first()
    assert (no_dev["rmse"], no_dev["pearson"], no_dev["bias"]) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="no rows"):
        fit.fit_grid(rows.limit(0), features, "mos", [0.01], 5, 0.03)


def test_features_may_be_named_like_the_fit_s_own_columns(spark):
    x, y = _data(40, clipped=False)
    rows = _rows(spark, x, y).toDF("n", "y", "dev", "x", "truth", "mos", "split")
    got = fit.fit_grid(rows, ["n", "y", "dev", "x", "truth"], "mos", [0.0], 30, 0.03, all_rows=True).first()
    assert got["weights"] == pytest.approx(_plain(x, y, 30, 0.03, 0.0, 0.7, 3000).tolist(), abs=1e-9)
