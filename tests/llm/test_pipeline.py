"""The pipeline's stages on the smallest documents: each on what the one before kept."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxlattice.llm.surrogates import find

DATA = "/root/testdata/sf0.001"
CLASHING = ["size", "target", "source_size", "bound", "score", "text_score", "kept", "label_id", "good", "_id", "_digest", "digest", "row", "mix_hash"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(kept[n].columns == COLUMNS for n in names[:-1])
    quality, near, private, mixed, packed = (kept[n].collect() for n in names)
    sets = lambda t: set(zip(*(t.encode().lower().split()[k:] for k in range(5)), strict=False))
    shingles = [sets(r["text"]) for r in near]
    assert {r["doc_id"] for r in near} < {r["doc_id"] for r in quality}
    assert not [1 for i, a in enumerate(shingles) for b in shingles[:i] if a and b and 5 * len(a & b) >= 4 * len(a | b)]
    before = {e for r in near for _, e, _ in find(r["text"])}
    assert before and not before & {e for r in private for _, e, _ in find(r["text"])}
    assert {r["doc_id"] for r in private} == {r["doc_id"] for r in near}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in private}
    pieces = defaultdict(int)
    for r in packed:
        pieces[r["sequence_id"]] += r["length"]
    assert max(pieces.values()) <= 1024 and {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls in every column, empty, blank and very long texts, equal rows and rows of one id, a column with a clashing
    name; and no rows at all."""
    long = " ".join(f"river{i % 97} garden{i % 89}" for i in range(20_000))
    rows = [(1, "one text of a few words, said twice", "en", "web", 5), (1, "one text of a few words, said twice", "en", "web", 5), (1, "another text under the same id, of other words", "en", None, None)]
    rows += [(None, None, None, None, None), (2, "", "en", "web", 0), (3, " \n ", "de", "book", 3), (4, long, "en", "book", len(long)), (5, long + " end", "en", "book", len(long) + 4)]
    rows += [(None, "mail a.b@example.com of Mr. John Smith", None, "web", 1), (6, "mail a.b@example.com of Dr. John Smith", "en", "web", 1)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    names = list(kept)
    assert all(kept[n].columns == [*COLUMNS, *CLASHING] for n in names[:-1])
    assert all(r[c] == f"own {c}" for n in names[:-1] for r in kept[n].collect() for c in CLASHING)
    if empty:
        assert not any(kept[n].count() for n in names)
        return
    before, near = ([(r["doc_id"], r["text"]) for r in kept[n].collect()] for n in names[:2])
    assert set(near) <= set(before) and len([x for x in near if x[1] == rows[0][1]]) == min(1, before.count(rows[0][:2]))
    assert len([x for x in near if x[0] in (4, 5)]) == min(1, len([x for x in before if x[0] in (4, 5)]))
    private = [r["text"] for r in kept[names[2]].collect()]
    assert len(private) == len(near) and not any(t and ("example.com" in t and "a.b@" in t or "Smith" in t) for t in private)
    assert {r["doc_id"] for r in kept[names[4]].collect()} == {r["doc_id"] for r in kept[names[3]].collect()}
