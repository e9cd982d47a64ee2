"""Token counts against the libraries, text by text."""

import random

import pytest
from pyspark.sql import functions as F

from voxlattice.llm import token_counts
from voxlattice.llm.queries_text import op13_token_counts
from voxlattice.llm.token_counts import Lengths, _counted, count_tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
PARTS = ["a", "B", "é", "ß", "Σ", "σ", "İ", "'s", "'LL", "'", "1", "23", "x9", " ", "  ", "\n", "\t", "\x1c", "\xa0", "　", "\x85", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>"]
PARTS += ["<|startof", "text|>", ".", ",", "!!", "-", "_", "漢", "字", "🙂", "́", "⃝", "ﬁ", "가", "ᄀ", "ᅡ", "▁", "<s>", "</s>", "<unk>", "½", "Ǆ", "word", "Another"]


def library(name):
    path = f"/opt/tokenizers/{name}"
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return path, lambda t: len(own.encode(t, add_special_tokens=False).ids)


def hard(n, most):
    rnd = random.Random(n)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_counts_equal_the_library(name):
    path, count = library(name)
    texts = hard(3000, 50)
    assert _counted([t.encode() for t in texts], Lengths(path)).tolist() == [count(t) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_long_texts_are_cut_where_nothing_changes(name, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 40)
    monkeypatch.setattr(token_counts, "BATCH", 64)
    monkeypatch.setattr(token_counts, "WORDS", 50)
    path, count = library(name)
    texts = [*hard(60, 900), "word " * 3000, "x" * 5000, "漢" * 500, "a1" * 2000, ("é, '" * 900)]
    own = Lengths(path)
    assert len(list(own.pieces(texts[60].encode()))) > 100
    assert _counted([t.encode() for t in texts], own).tolist() == [count(t) for t in texts]


def test_unknown_files_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "a b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    own.enable_padding(length=7)
    own.enable_truncation(1)
    own.save(str(tmp_path / "own.json"))
    assert Lengths(str(tmp_path / "own.json")).counts([b"a b", b"a,a b,a", b""]) == [1, 3, 0]


def test_rows(spark):
    path, count = library(FILES[0])
    long = "plain words and 12345 numbers " * 20_000
    rows = [(1, "A b"), (1, "A b"), (2, None), (None, "x y z"), (3, ""), (4, long), (5, "<|endoftext|> é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_bytes": F.lit("x"), "n_tokens": F.lit(None).cast("int")})
    got = sorted(map(tuple, count_tokens(docs, path, 5).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 5) for i, t in rows), key=str)
    assert count_tokens(docs.limit(0), path).count() == 0
    odd = docs.limit(1).withColumn("text", F.unhex(F.lit("61FF62")).cast("string"))
    assert count_tokens(odd, path).first()["n_bytes"] == 3


def test_query(spark):
    path, count = library(FILES[0])
    data = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op13_token_counts(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        n = count(r["text"] or "")
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)
