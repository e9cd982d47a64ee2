"""Language-model scores of whole texts: a causal self-attention model over subword ids, beside a unigram base.

Both see a text as its words (runs without white space, ASCII letters in lower case) and an end. Plan: texts are
encoded once and staged as ids; ids, what follows what, and words are counted over all training documents; the model is
trained on all of them, at every size: from a start that one task makes on a bounded part, in the table's own
partitions, each a stream of batches, and the models are averaged in a tree; scoring streams over the staged ids. The
base needs the count of each word of each text. A task numbers its different words while it encodes and stages the texts
as numbers too; it asks for the counts of its words, each once, from buckets of words, and its texts' sums are then
taken from an array. A bucket that many tasks ask is split by task, and gets its bounded counts in every part. Words are
compared as text. No word, however common, gathers its documents.

Defined results: a null text is empty (an end alone); a null id counts as the empty text (training); equal texts score
alike; without training documents the base is that of unseen words and the model stays as it is drawn; an empty table
gives no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import Scratch, freed, release, slices
from .subword import subwords

#: Words of a bucket; bytes of words in a part of a bucket; bytes of text in a batch.
BUCKET_WORDS, PART_BYTES, BATCH = 100_000, 16 << 20, 2 << 20
#: Different words, and words, of a turn: what a task numbers before it tells and starts anew; texts a task remembers
#: scores of.
COUNTED, TURN_WORDS, REMEMBERED = 300_000, 4_000_000, 1 << 14
#: Ids that the model's start is trained on; ids that a task trains on at a time; ids that a task counts at a time.
START_IDS, TRAIN_IDS, COUNT_IDS = 1_200_000, 1_000_000, 6_000_000
#: Models that one task averages, and tasks whose counts it sums; cells of a block of counts (16 bits).
FAN_IN, BLOCK = 32, 1 << 16


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _raw(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _small(size: int) -> str:
    """The type of staged ids."""
    return "<u2" if size <= 1 << 16 else "<u4"


class _Numbers(dict):
    """A number for each different word, from 0 on, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Seen:
    """The words that a task has met since it last told: their ids, and how often they stood in training texts."""

    def __init__(self, kind: str, size: int):
        self.number, self.kind = _Numbers(), kind
        self.flat, self.starts = np.empty(0, kind), np.zeros(1, np.int64)
        self.times, self.ids = np.zeros(0, np.int64), np.zeros(size, np.int64)
        self.texts = self.words = 0

    def add(self, split: list[list[bytes]], size: np.ndarray, taught: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers and the ids of all texts (lists of words), and where each text's ids end."""
        before = len(self.number)
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        parts = [encode(w.decode("utf-8", "replace")) for w in islice(self.number, before, None)]
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in parts], dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(parts), self.kind)])
        begin, count = self.starts[word], self.starts[word + 1] - self.starts[word]
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(begin - upto + count, count) + np.arange(int(count.sum()))]
        ends = np.concatenate([[0], upto])[np.cumsum(size)]
        times = np.bincount(word[np.repeat(taught, size)], minlength=len(self.number))
        times[: len(self.times)] += self.times
        self.times = times
        self.ids += np.bincount(ids[np.repeat(taught, np.diff(ends, prepend=0))], minlength=len(self.ids))
        self.texts, self.words = self.texts + len(split), self.words + len(word)
        return word, ids, ends

    def told(self) -> tuple[bytes, bytes, bytes]:
        return b"\n".join(self.number), self.times.astype("<i8").tobytes(), self.ids.astype("<i8").tobytes()


def _flat(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values[0 : ends[0]], values[ends[0] : ends[1]], ... as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * values.itemsize).astype("<i4")), pa.py_buffer(values)])


_ENCODED = "turn long, at int, id long, held_out boolean, digest binary, n_tokens long, ids binary, marks binary, words binary, times binary, id_times binary"


def encoded(docs: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """id, held_out, digest, n_tokens (words and the end) and ids of each row of docs (id, held_out, text). A word's ids
    are those of a space and the word, whatever stands around it, so each different word is encoded once. marks are the
    numbers of a text's words in its task's turn; (turn, at) name a row. One row of each turn tells its words, in the
    order of their numbers, and what was counted in training texts: times of each word, id_times of all ids."""
    names = [x.split()[0] for x in _ENCODED.split(", ")]

    def run(batches):
        coder, turn = subwords(tokenizer), pyspark.TaskContext.get().partitionId() << 20
        seen, held = _Seen(kind, coder.size), None

        def told(rows: list, counts: tuple) -> pa.RecordBatch:
            more = [pa.array([x, *[None] * (len(rows[0]) - 1)], pa.binary()) for x in counts]
            return pa.RecordBatch.from_arrays([*rows, *more], names=names)

        for batch in batches:
            raw = _raw(batch.column(2))
            for a, b in slices(raw, BATCH):
                split = [t.lower().split() for t in raw[a:b]]
                size, out = np.array([len(w) for w in split], np.int64), batch.column(1).slice(a, b - a)
                if held and (len(seen.number) > COUNTED or seen.words > TURN_WORDS):
                    yield told(held, seen.told())
                    seen, held, turn = _Seen(kind, coder.size), None, turn + 1
                if held:
                    yield told(held, (None,) * 3)
                at = np.arange(seen.texts, seen.texts + b - a, dtype=np.int32)
                marks, ids, ends = seen.add(split, size, ~out.to_numpy(zero_copy_only=False).astype(bool), coder.word)
                digests = pa.array([digest(t) for t in raw[a:b]], pa.binary())
                held = [pa.array(np.full(b - a, turn)), pa.array(at), batch.column(0).slice(a, b - a), out, digests, pa.array(size + 1), _flat(ids, ends), _flat(marks.astype("<u4"), np.cumsum(size))]
        if held:
            yield told(held, seen.told())

    return docs.mapInArrow(freed(run), _ENCODED)


def word_counts(tokens: DataFrame) -> DataFrame:
    """word, n: occurrences in all training texts."""

    def run(batches):
        for batch in batches:
            for words, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, times = words.split(b"\n") if words else [], np.frombuffer(times, "<i8")
                words, times = [w for w, n in zip(words, times.tolist(), strict=True) if n], times[times > 0]
                for i in range(0, len(words), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 16)], pa.binary()), pa.array(times[i : i + (1 << 16)])], names=["word", "n"])

    return tokens.where("times is not null").select("words", "times").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id in all training texts."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    out = np.zeros(size)
    sums = tokens.where("id_times is not null").select("id_times").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[sums["i"].to_numpy()] = sums["n"].to_numpy()
    return out


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of them, and where each row's end."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.cumsum([len(x) for x in parts], dtype=np.int64) // np.dtype(kind).itemsize


def _gathered(batches, kind: str, most: int):
    """Ids and ends of a stream of Arrow batches (ids), joined up to about `most` ids."""
    held, n = [], 0
    for batch in batches:
        column = batch.column("ids")
        held.append(column)
        n += column.nbytes // np.dtype(kind).itemsize
        if n >= most:
            yield _ids(pa.chunked_array(held), kind)
            held, n = [], 0
    if n:
        yield _ids(pa.chunked_array(held), kind)


def cell_counts(tokens: DataFrame, kind: str, cells, scratch: Scratch, name: str, size: int = 0) -> DataFrame:
    """block, cells, n: how often each cell occurs (cells(ids, ends) lists them), in blocks of BLOCK cells as arrays.
    With a `size`, a task counts in an array of so many cells. Parts are summed in a tree, so that a group holds FAN_IN parts of a block at
    most, however large the corpus."""
    shape = "part long, block int, cells binary, n binary"

    def counted(batches):
        if not size:
            for ids, ends in _gathered(batches, kind, COUNT_IDS):
                yield np.unique(cells(ids, ends), return_counts=True)
            return
        total = np.zeros(size, np.int64)
        for ids, ends in _gathered(batches, kind, COUNT_IDS // 3):
            total += np.bincount(cells(ids, ends), minlength=size)
        yield (some := np.flatnonzero(total)), total[some]

    def run(batches):
        task = pyspark.TaskContext.get().partitionId() << 12
        for turn, (found, n) in enumerate(counted(batches)):
            if not len(found):
                continue
            block = found // BLOCK
            first = np.flatnonzero(np.diff(block, prepend=-1))
            inside, n, stop = (found % BLOCK).astype("<u2"), n.astype("<u4"), [*first[1:], len(found)]
            rows = [(inside[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(first, stop, strict=True)]
            for i in range(0, len(rows), 256):
                own = rows[i : i + 256]
                columns = [pa.array([task + turn] * len(own), pa.int64()), pa.array(block[first[i : i + 256]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*own, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "cells", "n"])

    def adder(width: str):
        def added(group: pd.DataFrame) -> pd.DataFrame:
            at, n = np.frombuffer(b"".join(group["cells"]), "<u2"), np.frombuffer(b"".join(group["n"]), width)
            total = np.bincount(at, n, BLOCK)
            some = np.flatnonzero(total)
            return pd.DataFrame({"part": [int(group["part"].iloc[0])], "block": [int(group["block"].iloc[0])], "cells": [some.astype("<u2").tobytes()], "n": [total[some].astype("<i8").tobytes()]})

        return added

    # A task's parts have neighbouring numbers.
    made, level = tokens.select("ids").mapInArrow(freed(run), shape).withColumn("part", F.shiftright("part", 12)), 0
    while True:
        made = made.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part").applyInPandas(adder("<i8" if level else "<u4"), shape)
        made, level = scratch.stage(made, f"{name}{level}"), level + 1
        if not made.agg(F.max("part")).first()[0]:
            return made.select("block", "cells", "n")


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of blocks, rising."""
    table = table.sort_by("block")
    cells, n = table["cells"].to_pylist(), table["n"].to_pylist()
    base = np.repeat(table["block"].to_numpy().astype(np.int64) * BLOCK, [len(x) // 2 for x in cells])
    return (base + np.frombuffer(b"".join(cells), "<u2")).astype(np.int32), np.frombuffer(b"".join(n), "<i8").astype(np.float32)


def largest(blocks: DataFrame, most: int) -> DataFrame:
    """The cells that count most, `most` at the most: all that count alike, but for less than a tenth, or none of them."""

    def level(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(n) * 8).astype(np.int64)

    def bins(batches):
        total = np.zeros(512, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(level(np.frombuffer(x, "<i8")), minlength=512)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bin", "n"])

    least, left = 0, most
    for row in sorted(blocks.select("n").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect(), reverse=True):
        left -= row["n"]
        if left < 0:
            break
        least = row["bin"]

    def kept(batches):
        for batch in batches:
            rows = []
            for cells, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cells, n = np.frombuffer(cells, "<u2"), np.frombuffer(n, "<i8")
                keep = level(n) >= least
                rows.append((cells[keep].tobytes(), n[keep].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["block", "cells", "n"])

    return blocks.mapInArrow(kept, "block int, cells binary, n binary")


def pair_totals(blocks: DataFrame) -> np.ndarray:
    """All that follows each pair, kept or not."""
    rows = attention.ROWS

    def run(batches):
        for batch in batches:
            for block, cells, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                total = np.bincount(np.frombuffer(cells, "<u2") // rows, np.frombuffer(n, "<i8"), BLOCK // rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)) + block * (BLOCK // rows)), pa.array(total)], names=["pair", "n"])

    out, found = np.zeros(attention.PAIRS), blocks.mapInArrow(run, "pair long, n double").toArrow()
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out


#: The last model's values in this Python worker: tasks of one job share them.
_VALUES: dict[tuple, attention.Values] = {}


class Model:
    """What is counted for a model: its inventory and cells (sparse, to be sent once)."""

    def __init__(self, inventory: attention.Inventory, counts: dict[str, np.ndarray], pair_of: np.ndarray, paired: tuple):
        self.key, self.inventory, self.paired = uuid.uuid4().hex, inventory, paired
        self.counts = {name: ((at := np.flatnonzero(n)).astype(np.int32), n[at].astype(np.float32)) for name, n in [*counts.items(), ("pair_of", pair_of)]}

    def values(self, left_out: bool) -> attention.Values:
        if (self.key, left_out) not in _VALUES:
            _VALUES.clear()
            dense = {name: np.zeros(attention.ROWS**2) for name in self.counts}
            for name, (at, n) in self.counts.items():
                dense[name][at] = n
            pair_of = dense.pop("pair_of").astype(np.int32)
            _VALUES[self.key, left_out] = attention.Values.of(dense, pair_of, *self.paired, left_out)
        return _VALUES[self.key, left_out]


def fit(train: DataFrame, inventory: attention.Inventory, kind: str, n_ids: int, end_id: int, scratch: Scratch) -> tuple[Broadcast, dict]:
    """The model of all rows of train (digest, id, ids): its counts, sent, and its parameters."""
    spark, end_row, square = train.sparkSession, int(inventory.row[end_id]), attention.ROWS**2
    context = spark.sparkContext
    sent = context.broadcast(inventory)
    line = lambda ids, ends: attention.laid_out(sent.value.row[ids], ends, end_row)[0]

    def after(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.concatenate([cells + i * square for i, cells in enumerate(attention.followers(line(ids, ends)))])

    at, n = _cells(cell_counts(train, kind, after, scratch, "after", 3 * square).toArrow())  # a number for each two rows at most
    dense = np.zeros(3 * square)
    dense[at] = n
    counts = dict(zip(["direct", "skipped", "further"], dense.reshape(3, square), strict=True))
    pair_of = attention.pairs_of(counts["direct"], end_row)
    pairs = context.broadcast(pair_of)
    paired = cell_counts(train, kind, lambda ids, ends: attention.pair_followers(line(ids, ends), pairs.value), scratch, "paired")
    at, n = _cells(largest(paired, attention.CELLS).toArrow())
    paired = at, n, pair_totals(paired)
    model = Model(inventory, counts, pair_of, paired)
    told = context.broadcast(model)
    del dense, counts, paired, model
    release()

    def trained(rows: DataFrame, start: dict, rate: float, batch: int, name: str) -> tuple[dict, float]:
        first = attention.packed(start)

        def run(batches):
            part = pyspark.TaskContext.get().partitionId()
            trainer = attention.Trainer(attention.unpacked(first), told.value.values(True), rate, part, batch)
            for ids, ends in _gathered(batches, kind, TRAIN_IDS):
                trainer.learn(*attention.laid_out(told.value.inventory.row[ids], ends, end_row)[:2])
            if trainer.windows:
                model = [pa.array([part], pa.int64()), pa.array([float(trainer.windows)]), pa.array([attention.packed(trainer.p)], pa.binary())]
                yield pa.RecordBatch.from_arrays(model, names=["part", "weight", "model"])

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            model = np.average([np.frombuffer(m, "<f4") for m in group["model"]], axis=0, weights=group["weight"]).astype("<f4")
            return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "weight": [group["weight"].sum()], "model": [model.tobytes()]})

        shape = "part long, weight double, model binary"
        made, level = scratch.stage(rows.select("ids").mapInArrow(freed(run), shape), name), 0
        while made.count() > FAN_IN:  # a tree of means
            made = scratch.stage(made.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(mean, shape), f"{name}-{level}")
            level += 1
        found = made.orderBy("part").collect()
        if not found:
            return start, 0.0
        weights = [r["weight"] for r in found]
        flat = np.average([np.frombuffer(r["model"], "<f4") for r in found], axis=0, weights=weights)
        return attention.unpacked(flat.astype("<f4").tobytes()), sum(weights)

    # The start: a bounded part of the ids, chosen by hash, in one task.
    few = max(1, round(n_ids / START_IDS))
    first, _ = trained(train.where(F.pmod(F.xxhash64("digest", "id"), F.lit(few)) == 0).repartition(1), attention.fresh(), 0.05, 128, "first")
    return told, trained(train, first, 0.02, 4096, "models")[0]


def model_scores(tokens: DataFrame, sent: Broadcast, p: dict, kind: str, end_id: int) -> DataFrame:
    packed = attention.packed(p)

    def run(batches):
        model = sent.value
        p, values = attention.unpacked(packed), model.values(False)
        known: dict[bytes, float] = {}  # equal texts are scored once while they are remembered
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            digests = batch.column("digest").to_pylist()
            at = {d: i for i, d in enumerate(digests) if d not in known}
            fresh, ids = list(at), batch.column("ids").take(pa.array(at.values(), pa.int64()))
            for a, b in slices(ids.to_pylist(), 1 << 19):
                scores = attention.score(p, values, model.inventory, *_ids(ids.slice(a, b - a), kind), end_id)
                known.update(zip(fresh[a:b], scores.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("turn", "at", "id", "held_out", "n_tokens")), pa.array([known[d] for d in digests], pa.float64())],
                names=["turn", "at", "id", "held_out", "n_tokens", "score"],
            )

    rows = tokens.select("turn", "at", "id", "held_out", "digest", "n_tokens", "ids")
    return rows.mapInArrow(freed(run), "turn long, at int, id long, held_out boolean, n_tokens long, score double")


def base_scores(tokens: DataFrame, counts: DataFrame, total: int, kinds: int, ends: int) -> DataFrame:
    """turn, at, base_score, n_known of each row of tokens."""
    told = tokens.where("times is not null").select("turn", "words")
    buckets = max(1, -(-kinds // BUCKET_WORDS))
    salts = max(1, -(-(told.agg(F.sum(F.length("words"))).first()[0] or 0) // (buckets * PART_BYTES)))
    level = np.log10(total + kinds + 1)
    end = np.log10(ends + 1) - level

    def ask(batches):
        for batch in batches:
            for turn, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words.split(b"\n") if words else []
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(words) else ():
                    columns = [pa.array([int(bucket[own[0]])], pa.int32()), pa.array([turn], pa.int64())]
                    columns += [pa.array([x], pa.binary()) for x in (b"\n".join(words[i] for i in own.tolist()), own.astype("<u4").tobytes())]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "turn", "words", "places"])

    def look(key, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        count = dict(zip(known["word"], known["n"].tolist(), strict=True))
        found = [np.fromiter(map(count.get, words.split(b"\n"), repeat(0)), "<i8").tobytes() for words in asked["words"]]
        return pd.DataFrame({"turn": asked["turn"], "places": asked["places"], "n": found})

    def add(key, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        places, n = np.frombuffer(b"".join(found["places"]), "<u4"), np.frombuffer(b"".join(found["n"]), "<i8")
        count = np.zeros(len(places), np.int64)
        count[places] = n
        marks = np.frombuffer(b"".join(texts["marks"]), "<u4")
        text = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in texts["marks"]])
        base = np.bincount(text, (np.log10(count + 1) - level)[marks], len(texts)) + end
        known = np.bincount(text, (count > 0)[marks], len(texts)).astype(np.int64) + (ends > 0)
        return pd.DataFrame({"turn": texts["turn"], "at": texts["at"], "base_score": base, "n_known": known})

    asked = told.mapInArrow(freed(ask), "bucket int, turn long, words binary, places binary").withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(salts)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    known = counts.select((F.crc32("word") % buckets).cast("int").alias("bucket"), every, "word", "n")
    found = asked.groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "salt")).applyInPandas(look, "turn long, places binary, n binary")
    texts = tokens.select("turn", "at", "marks")
    return texts.groupBy("turn").cogroup(found.groupBy("turn")).applyInPandas(add, "turn long, at int, base_score double, n_known long")


def score_texts(docs: DataFrame, tokenizer: str, held_out: Column, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document; those for which
    `held_out` holds teach neither model."""
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    size = subwords(tokenizer).size
    kind = _small(size)
    tokens = scratch.stage(encoded(rows, tokenizer, kind), "tokens")
    train = tokens.where("not held_out")
    counts = scratch.stage(word_counts(tokens), "counts")
    kinds, in_words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = train.count()
    total, kinds = in_words + ends, kinds + (ends > 0)

    by_id = id_counts(tokens, size)
    by_id[end_id] += ends
    counted, p = fit(train, attention.Inventory.of(by_id), kind, int(by_id.sum()), end_id, scratch)
    scored = model_scores(tokens, counted, p, kind, end_id)
    base = base_scores(tokens, counts, total, kinds, ends)
    out = scored.join(base, ["turn", "at"])
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
