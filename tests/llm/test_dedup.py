"""Repeated byte strings and near duplicates, texts and vectors, against brute force and on edge rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.llm import shingle_links as S
from voxlattice.llm.suffix_dedup import Suffixes, remove_repeats
from voxlattice.llm.vector_links import vector_links

RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdeé"), 5)) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup_equals_brute_force(spark, hot):
    passage, other = prose(60), prose(45)
    texts = [prose(80) + passage + prose(30), passage, prose(10) + passage[40:300] + prose(20), other + prose(5) + other, "x" * 700, "", None, "short", prose(90)]
    texts += [prose(50) + passage[i * 3 : i * 3 + 230] + prose(20) for i in range(8)]
    texts += [texts[-1], texts[-1], passage[:199], passage[:200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 200)


def test_salted_parts_compare_bytes(spark, monkeypatch):
    """With hashes that all agree across parts, only equal bytes go."""
    import voxlattice.llm.suffix_dedup as D

    gram = "0123456789abcdefghijklmnopqrstuv" * 2  # the anchor may lie in what all share; what stands around it differs
    texts = [prose(40)[:150] + gram + prose(40)[:150] for _ in range(30)]
    texts += [texts[0] + " x", texts[1] + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    keyed = docs.select(F.struct(F.lit(True).alias("known"), F.col("doc_id").alias("id")).alias("id"), F.encode("text", "UTF-8").alias("body"), F.unhex(F.sha2("text", 256)).alias("digest"))
    same = keyed.select(F.lit(1).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"), "digest", F.lit(0).cast("long").alias("a"), F.lit(True).alias("open"))
    found = D._same_windows(same, keyed, keyed.select("digest", "id"), 200, D.Scratch(spark, "test"))
    named = {r["digest"]: r["id"]["id"] for r in keyed.collect()}
    assert sorted(named[r["digest"]] for r in found.collect()) == [0, 1, 30, 31]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs, hot=2).collect()}
    assert [got[i] for i in range(len(texts))] == [b[1] for b in brute_spans(texts, 200)]


def test_suffix_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = prose(60)
    rows = remove_repeats(spark.createDataFrame([(1, long), (1, long), (None, "a"), (2, None)], schema)).collect()
    least = remove_repeats(spark.createDataFrame([(-(1 << 63), "a"), (None, "b")], schema)).collect()
    assert {r["doc_id"] for r in least} == {-(1 << 63), None}
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 1, 0), (1, len(long.encode()), len(long.encode())), (1, len(long.encode()), len(long.encode())), (2, 0, 0)]


def test_suffix_sort_orders_windows():
    data = bytes(RNG.integers(97, 99, 400).astype(np.uint8))
    s = Suffixes(data, 20)
    start = np.arange(300)
    order = s.sort(start, np.repeat([1, 2, 3], 100))
    for part in range(3):
        mine = order[part * 100 : part * 100 + 100]
        assert [data[i : i + 20] for i in mine] == sorted(data[i : i + 20] for i in range(part * 100, part * 100 + 100))
    a, b = np.array([0, 5, 7]), np.array([0, 9, 60])
    common = [next((k for k in range(20) if data[x + k] != data[y + k]), 20) for x, y in zip(a, b, strict=True)]
    assert s.common(a, b).tolist() == common


def brute_links(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(text, share):
    return " ".join(w if RNG.random() > share else RNG.choice(WORDS) for w in text.split())


@pytest.mark.parametrize("width", [2, 5])
def test_shingle_links_equal_brute_force(spark, width):
    bases = [prose(120) for _ in range(4)]
    texts = [edited(b, s) for b in bases for s in (0, 0, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1) for _ in range(3)]
    texts += [None, "", " \t\n", "One", "one", "one two", "ONE two", prose(3), texts[0].upper(), texts[0].replace(" ", "\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in S.shingle_links(docs, width).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts, width, 80)


def test_near_duplicates_leave_one_and_edges(spark):
    schema = "doc_id long, text string"
    assert S.shingle_links(spark.createDataFrame([], schema)).count() == 0
    text = prose(50)
    docs = spark.createDataFrame([(2, text), (1, text), (1, text), (None, text), (5, None), (6, "")], schema)
    assert sorted(r["doc_id"] or 0 for r in S.drop_near_duplicates(docs).collect()) == [0, 1, 5, 6]


def test_rows_of_one_id_are_linked_each_by_its_text(spark):
    a, b, c = prose(60), prose(60), prose(60)
    near = b.rsplit(" ", 1)[0]
    docs = spark.createDataFrame([(5, a), (5, b), (9, near), (3, c), (7, c), (3, c)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in S.shingle_links(docs).collect())
    assert got == [(3, 56, 3, True), (3, 56, 3, True), (5, 56, 5, True), (5, 56, 5, True), (7, 56, 3, False), (9, 55, 5, False)]
    assert sorted(map(tuple, S.drop_near_duplicates(docs).collect())) == sorted([(5, a), (5, b), (3, c)])
    # A row of a shared id whose text is a near copy of a smaller id's goes alone.
    docs = spark.createDataFrame([(5, a), (5, near), (1, b)], "doc_id long, text string")
    assert sorted(map(tuple, S.drop_near_duplicates(docs).collect())) == sorted([(5, a), (1, b)])


def test_keys_guarantee_pairs_within_the_distance():
    a = RNG.integers(0, 1 << S.BITS, (200, S.SYMBOLS)).astype(np.uint64)
    b = a.copy()
    for row in b:
        wrong = RNG.choice(S.SYMBOLS, S.DISTANCE, replace=False)
        row[wrong] = (row[wrong] + 1) % (1 << S.BITS)
    assert all(set(x) & set(y) for x, y in zip(S.keys(a).tolist(), S.keys(b).tolist(), strict=True))
    assert (S.unpacked(S.packed(a)) == a).all()


def brute_vectors(vectors):
    fit = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    up, links = list(range(len(vectors))), [0] * len(vectors)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(vectors)):
        for j in range(i):
            if fit[i] and fit[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], np.float64), np.array(vectors[j], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)))
                    up[b] = a
    return [(links[i], find(i)) for i in range(len(vectors))]


def test_vector_links_equal_brute_force(spark):
    base = RNG.normal(size=(6, 16))
    vectors = [(b + RNG.normal(size=16) * s).astype(np.float32).tolist() for b in base for s in (0, 0, 0.1, 0.2, 0.25, 0.3) for _ in range(3)]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1e30] * 16, [1e-30] * 16, [1.0] * 8, [2.0] * 8]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("tile", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_links(rows, tile_rows=20).collect()}
    assert [got[i] for i in range(len(vectors))] == brute_vectors(vectors)
    assert vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    same = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [0.01, 1.0]), (7, [1.0, 0.01]), (None, [1.0, 0.02])], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in vector_links(same).collect())
    assert got == [(0, 2, 5), (5, 1, 5), (5, 2, 5), (7, 2, 5), (9, 1, 5)]
