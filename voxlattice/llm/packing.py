"""Best-two-fit packing of documents into sequences of at most `capacity` tokens.

Plan: one pass tokenizes and cuts documents into pieces (staged: ids and lengths are not computed twice). What a bin
may hold depends on piece lengths alone, so the packing works on the histogram of lengths, at most `capacity` numbers
however large the corpus. A bin is filled greedily with the longest pieces that fit; then its smallest piece gives way
to two unpacked ones if they fill the widened gap more tightly. The bin is a pattern, repeated while its lengths last.
Each piece is ranked within its length (hashed into buckets, so that no length lands in one task) and looks its place
up in the pattern table, whose size the number of lengths bounds.

Defined results: a null text is an empty document (one piece, the end token alone); documents of any length are kept
whole, in pieces; equal rows are packed as separate documents; null ids stay null; an empty table gives no rows; extra
columns are ignored, whatever their names."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket, freed, slices
from .subword import subwords

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only those over the capacity are cut, and the first may be shorter."""
    head = total % capacity or min(total, capacity)
    return [(0, head), *((start, capacity) for start in range(head, total, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece of each document."""

    def run(batches):
        encode = subwords(tokenizer).encode
        for batch in batches:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts, 4 << 20):
                ids, ends = encode(texts[a:b])
                rows, begin = [], 0
                for i, end in zip(range(a, b), ends.tolist(), strict=True):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin = end
                    rows += [(i, k, s, n, zlib.crc32(own[s : s + n])) for k, (s, n) in enumerate(cut(len(own), capacity))]
                at, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freed(run), PIECES)


class _Left:
    """Lengths that still have pieces, sorted, with their counts."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.count)

    def longest(self, most: int) -> int:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0

    def take(self, length: int, times: int = 1) -> None:
        self.count[length] -= times
        if not self.count[length]:
            self.lengths.remove(length)

    def give(self, length: int) -> None:
        if not self.count[length]:
            self.lengths.insert(bisect_right(self.lengths, length), length)
        self.count[length] += 1

    def best_two(self, most: int) -> tuple[int, int]:
        """The two lengths with the largest sum up to `most`."""
        best, low, high = (0, 0), 0, len(self.lengths) - 1
        while low <= high:
            a, b = self.lengths[low], self.lengths[high]
            if low == high and self.count[a] < 2 or a + b > most:
                high -= 1
                continue
            best = max(best, (b, a), key=sum)
            low += 1
        return best


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths in a bin, how many such bins)] that pack a histogram of lengths."""
    left, patterns = _Left(histogram), []
    while left.lengths:
        own, gap = [], capacity
        while n := left.longest(gap):
            own.append(n)
            left.take(n)
            gap -= n
        if len(own) > 1 and gap:
            small = own[-1]
            pair = left.best_two(gap + small)
            if sum(pair) > small:
                own[-1:] = pair
                left.give(small)
                for n in pair:
                    left.take(n)
        need = {n: own.count(n) for n in own}
        times = min(left.count[n] // c for n, c in need.items())
        for n, c in need.items():
            if times:
                left.take(n, c * times)
        patterns.append((own, times + 1))
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: the first sequence, pieces of that length in a sequence, the first offset."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for own, times in patterns:
        offset = 0
        for n in sorted(set(own), reverse=True):
            c = own.count(n)
            rows.append((n, seen.get(n, 0), sequence, c, offset))
            seen[n] = seen.get(n, 0) + c * times
            offset += n * c
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def best_fit_packing(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 20_000
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cuts = scratch.stage(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    lengths = cuts.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in lengths}
    table = places(best_two_fit(histogram, capacity))
    buckets = max(64, sum(histogram.values()) // bucket_rows)

    cuts = cuts.withColumn("bucket", bucket(buckets, F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    before = cuts.groupBy("length", "bucket").count()
    before = before.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cuts.withColumn("inside", F.row_number().over(inside)).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1)

    key = (table["length"] << 44) + table["rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            over = rank - table["rank"][at]
            sequence = table["sequence"][at] + over // table["each"][at]
            offset = table["offset"][at] + over % table["each"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
