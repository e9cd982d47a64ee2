"""Hard negatives and whitening against brute force and a dense solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.llm.hard_negatives import Tree, _meetings, dual_search, hard_negatives
from voxlattice.llm.queries_vectors import op12_whitening
from voxlattice.llm.whitening import block_lanczos, whiten, whole_numbers

RNG = np.random.default_rng(11)
INPUT = "vec_id long, label int, vector array<bigint>, asks boolean"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    rows = [(k, i, label, v, asks) for k, (i, label, v, asks) in enumerate(rows) if label is not None and v and None not in v]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for k, i, label, v, asks in rows:
        if not asks:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, n, tag == label) for n, j, tag, w, _ in rows if n != k and len(w) == len(v)]
        for p in sorted((s for s in scored if s[3]), key=order)[:positives]:
            fit = sorted((s for s in scored if not s[3] and low * p[0] <= 100 * s[0] <= high * p[0]), key=order)
            out += [(i, p[1], r, n[1], p[0], n[0]) for r, n in enumerate(fit[:negatives], 1)]
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(map(tuple, hard_negatives(df, F.col("asks"), **kw).collect()), key=str)


@pytest.mark.parametrize("spread", [3, 1 << 20, 1 << 29])
def test_negatives_equal_brute_force(spark, spread):
    centres = RNG.integers(-spread, spread, (6, 5))
    rows = []
    for i in range(400):
        near = centres[i % 6] + RNG.integers(-max(1, spread // 8), max(2, spread // 8), 5)
        rows.append((i % 390, int(RNG.integers(0, 3)), near.tolist(), i % 9 == 0))
    rows += [(None, 1, centres[0].tolist(), True), (None, 2, centres[0].tolist(), None), (700, 1, [1, 2], True), (701, 1, [1, 2], True), (702, 0, [1, 1], False)]
    df = spark.createDataFrame(rows, INPUT).repartition(3)
    # Row numbers follow partitions, so ties between rows of one id are told apart by what is returned only.
    assert found(df, shard_rows=40, block_rows=10, leaf_rows=8) == brute(rows)


def test_hot_copies_and_odd_rows(spark):
    rows = [(i, 0, [4, 3, 0], i % 20 == 0) for i in range(300)] + [(1000 + i, 1, [3, 3, 0], False) for i in range(300)]
    rows += [(2000, None, [9, 9, 9], True), (2001, 0, None, True), (2002, 0, [], True), (2003, 0, [1, None, 1], True), (2004, 5, [1, 1, 1], True)]
    rows += [(2005, 6, [-5, 0, 0], True), (2006, 6, [5, 0, 0], True)]
    df = spark.createDataFrame(rows, INPUT).withColumns({"row": F.lit("x"), "dim": F.lit(1), "v": F.lit(None).cast("string"), "cell": F.lit(2)})
    assert found(df, shard_rows=64, block_rows=8, leaf_rows=16) == brute(rows)
    assert found(df.limit(0)) == []
    assert found(df.where("label = 5")) == []
    assert found(df, positives=1, negatives=2, low=10, high=200) == brute(rows, 1, 2, 10, 200)


def test_node_pairs_rule_out_groups_and_lose_nothing():
    points = np.concatenate([RNG.integers(90, 110, (64, 4)), RNG.integers(-110, -90, (64, 4))])
    labels = np.repeat([0, 1], 64)
    side = {"tree": Tree(points, labels, 8), "points": points, "labels": labels, "rows": np.arange(128), "ranks": np.arange(128)}
    low, high = np.full((128, 1), 1), np.full((128, 1), 1 << 40)
    i, j, _ = _meetings(side["tree"], side["tree"], low[:, 0], high[:, 0], True, 0.0)
    assert 0 < len(i) <= 16 * 16 // 2  # opposite clusters never meet
    other = {**side, "rows": np.arange(128) + 1000}
    a, _, c, score = dual_search(side, other, low, high, 3, True)
    exact = np.where(labels[:, None] == labels[None, :], points @ points.T, -1)
    best = -np.sort(-exact, axis=1)[:, :3]
    assert all(sorted(score[a == x], reverse=True) == best[x].tolist() for x in range(128))
    assert (score == (points[a] * points[c]).sum(1)).all()


@pytest.mark.parametrize("dim, rank", [(64, 64), (200, 200), (40, 3), (5, 5), (30, 1)])
def test_lanczos_equals_a_dense_solver(dim, rank):
    x = RNG.standard_normal((500, rank)) @ RNG.standard_normal((rank, dim)) * np.linspace(1, 3, dim)
    cov = x.T @ x / 500
    value, vector = block_lanczos(lambda b: cov @ b, dim, min(8, dim))
    dense = np.linalg.eigvalsh(cov)[::-1][: len(value)]
    assert np.abs(value - dense).max() < 1e-12 * dense[0]
    assert np.abs(cov @ vector - vector * value).max() < 1e-11 * dense[0]
    assert np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-12


def test_lanczos_restarts():
    turned = np.linalg.qr(RNG.standard_normal((150, 150)))[0]
    cov = (turned * np.linspace(1, 1.5, 150)) @ turned.T  # close values: many passes, and the space is full before
    asked = []
    value, vector = block_lanczos(lambda b: asked.append(b.shape[1]) or cov @ b, 150, 4, width=4, most=5, passes=2000)
    assert len(asked) > 5 and np.abs(value - np.linspace(1, 1.5, 150)[::-1][:4]).max() < 1e-12
    # Breakdown: the block's image adds nothing new, and all values are the same.
    value, _ = block_lanczos(lambda b: 3 * b, 20, 8, width=8)
    assert np.abs(value - 3).max() < 1e-12


def dense(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1], vector[:, ::-1]
    return x, [sum(int(e) ** 2 for e in row) for row in n * x - s], y @ vector[:, :components] / np.sqrt(value[:components]), value[:components] / value.sum()


def check(rows, ids, vectors):
    _, deviation, whitened, explained = dense(vectors)
    by_id = {i: k for k, i in enumerate(ids)}
    assert len(rows) == len(ids) * whitened.shape[1]
    for r in rows:
        k, c = by_id[r["vec_id"]], r["component"] - 1
        assert r["n"] == len(ids) and r["deviation"] == deviation[k]
        assert abs(abs(r["whitened"]) - abs(whitened[k, c])) < 1e-8 and abs(r["explained"] / explained[c] - 1) < 1e-8
        assert r["identity_error"] < 1e-9


def test_whitening_query(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    check(op12_whitening(spark, data).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_odd_rows(spark):
    vectors = RNG.standard_normal((90, 12)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"x": F.lit("y"), "dim": F.lit(0), "n": F.lit(1)})
    found = whiten(whole_numbers(df.repartition(5), 1024, 100_000))
    check(found.collect(), list(range(90)), vectors)
    assert found.count() == 90 * 8
    assert whiten(whole_numbers(df.limit(0), 1024, 100_000)).collect() == []
    # Equal rows have no variance; another length is a fit of its own.
    equal = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0]), (4, [2.0]), (4, [3.0])], "vec_id long, embedding array<double>")
    got = whiten(whole_numbers(equal, 1024, 100_000)).orderBy("vec_id", "whitened").collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [(None, 1, 3, 3072**2), (4, 1, 3, 0), (4, 1, 3, 3072**2)] or len(got) == 3
    assert all(r["explained"] == 1 and abs(abs(r["whitened"]) - (0 if r["deviation"] == 0 else 1.5**0.5)) < 1e-12 for r in got)


def test_large_numbers_are_exact_or_refused(spark):
    big = spark.createDataFrame([(i, [1 << 40, (i - 1) << 35]) for i in range(3)], "vec_id long, x array<bigint>")
    got = whiten(big).collect()
    assert sorted(int(r["deviation"]) for r in got) == sorted([0, (3 << 35) ** 2, (3 << 35) ** 2])
    with pytest.raises(OverflowError):
        whiten(spark.createDataFrame([(1, [1 << 62]), (2, [1 << 61])], "vec_id long, x array<bigint>"))
