"""Repeated byte strings by a hash-compared suffix sort.

A byte goes if it is covered by a string of `length` bytes that also starts somewhere else. Sorting all suffixes of a
corpus is not needed for that: windows of `length` bytes that are equal choose the same anchor, the least hash of their
k-grams, at the same place. Anchors (about one in 85 bytes) are counted by key; windows whose anchor's key occurs once
are unique. The others' contexts meet by key, and there the windows are sorted as suffixes: a prefix polynomial hash of
the joined contexts gives the longest common extension of any two by binary search, so a comparison takes a logarithm of
`length` steps, and the sort is a merge sort. Neighbours with a common extension of `length` bytes are repeats; their
bytes are compared, so that a hash collision cannot remove anything.

Equal texts are folded first, equal contexts in each batch and group. A key with more than `hot` anchors is salted:
each part is sorted by itself and passes on one of each different window; where parts agree in 128 bits of hash, the
windows' bytes are fetched and compared. Keys that make up much of all anchors are looked up by broadcast, so that they
never gather. Texts move twice: to the contexts that repeat, and to the spans that go.

Defined results: null texts are empty; texts shorter than `length` keep all bytes; equal rows are copies of each other
and lose all bytes; a null id stays null; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, Scratch, freed, mix, ragged, slices

_POWERS, _OTHER = Powers(), Powers(0xC2B2AE3D27D4EB4F)
_GRAM = 32
#: Keys that are looked up by broadcast, at most: those with more than this share of all anchors.
_FREQUENT = 1 << 16


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width], for each i: from running minima of blocks, forwards and backwards."""
    n = len(values)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int) -> list[tuple[np.ndarray, ...]]:
    """For each text its anchors: key, place, and the first and last window start that chose it."""
    none = (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    out = [none] * len(texts)
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        return out
    joined = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    ends = np.cumsum([len(texts[i]) for i in long])
    prefix = _POWERS.prefix(joined)
    at = np.arange(len(joined) - _GRAM + 1)
    gram = mix(_POWERS.span(prefix, at, at + _GRAM))
    # The place stands in the low bits: the leftmost of equal hashes wins, in every copy of a window.
    bits = np.uint64(len(joined).bit_length())
    least = _least((gram >> bits << bits) | at.astype(np.uint64), length - _GRAM + 1)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    for i, end in zip(long, ends.tolist(), strict=True):
        start = end - len(texts[i])
        own = place[start : end - length + 1]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        last = np.append(first[1:], len(own)) - 1
        out[i] = (gram[own[first]], own[first] - start, first, last)
    return out


class Suffixes:
    """Windows of a buffer as suffixes: the common extension of any two by binary search on prefix hashes."""

    def __init__(self, data: bytes, length: int):
        self.bytes = np.frombuffer(data, np.uint8)
        self.prefix, self.length = _POWERS.prefix(self.bytes), length
        _POWERS.grow(len(self.bytes) + 1)

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        return _POWERS.span(self.prefix, start, start + size)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the windows at a and b have in common, up to their length."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashes(a, mid) == self.hashes(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether window a sorts before window b, and whether they are equal."""
        equal = self.hashes(a, self.length) == self.hashes(b, self.length)
        less = np.zeros(len(a), bool)
        left = np.flatnonzero(~equal)
        x, y = self.bytes[a[left]], self.bytes[b[left]]
        less[left] = x < y
        left = left[x == y]
        if len(left):
            k = self.common(a[left], b[left])
            equal[left] = k >= self.length
            k = np.minimum(k, self.length - 1)
            less[left] = ~equal[left] & (self.bytes[a[left] + k] < self.bytes[b[left] + k])
        return less, equal

    def sort(self, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order of windows within equal `segment`s (ascending): a bottom-up merge sort of all segments at once. In
        each round, each window finds its place in the neighbouring run by binary search."""
        n = len(start)
        head = np.flatnonzero(np.diff(segment, prepend=segment[0] - 1 if n else 0))
        size = np.diff(np.append(head, n))
        base, count = np.repeat(head, size), np.repeat(size, size)
        order, inside = np.arange(n), np.arange(n) - base
        width, most = 1, int(size.max()) if n else 0
        while width < most:
            live = np.flatnonzero(count > width)
            run = inside[live] // width
            other = (run ^ 1) * width
            span = np.clip(count[live] - other, 0, width)
            live, run, other, span = (x[span > 0] for x in (live, run, other, span))
            low, high = np.zeros(len(live), np.int64), span.copy()
            mine = start[order[live]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                theirs = start[order[base[live[open_]] + other[open_] + mid]]
                less, equal = self.before(theirs, mine[open_])
                # Equal windows of the earlier run come first.
                up = less | (equal & (run[open_] & 1 == 1))
                low[open_] = np.where(up, mid + 1, low[open_])
                high[open_] = np.where(up, high[open_], mid)
            place = base[live] + (run & ~1) * width + inside[live] % width + low
            moved = order.copy()
            moved[place] = order[live]
            order, width = moved, width * 2
        return order

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, self.length)
        return np.concatenate([(view[a[i : i + 20_000]] == view[b[i : i + 20_000]]).all(1) for i in range(0, len(a), 20_000)] or [np.empty(0, bool)])


def repeats(contexts: list[bytes], group: np.ndarray, place: np.ndarray, width: np.ndarray, length: int):
    """Windows of different contexts (windows start at 0 .. width of each; its anchor is at `place`) in sorted order:
    the context and start of each, and whether an equal window of its group stands elsewhere."""
    suffixes = Suffixes(b"".join(contexts), length)
    begin = np.cumsum([0, *map(len, contexts)])[:-1]
    owner = np.repeat(np.arange(len(contexts)), width + 1)
    start = ragged(np.zeros(len(width), np.int64), width + 1)
    # Equal windows hold their anchor at the same distance.
    distance = place[owner] - start
    order = np.lexsort((distance, group[owner]))
    owner, start, distance = owner[order], start[order], distance[order]
    fresh = np.diff(distance, prepend=-1) != 0
    fresh[1:] |= np.diff(group[owner]) != 0
    segment = np.cumsum(fresh)
    at = begin[owner] + start
    order = suffixes.sort(at, segment)
    owner, start, at, segment = owner[order], start[order], at[order], segment[order]
    pair = np.flatnonzero((segment[1:] == segment[:-1]) & (suffixes.hashes(at[1:], length) == suffixes.hashes(at[:-1], length)))
    good = suffixes.same_bytes(at[pair], at[pair + 1])
    again = np.zeros(len(at), bool)
    again[pair[good]] = again[pair[good] + 1] = True
    for i in pair[~good].tolist():  # two windows with one hash: settle their segment byte by byte
        mine = np.flatnonzero(segment == segment[i])
        seen: dict[bytes, int] = {}
        for j in mine.tolist():
            key = suffixes.bytes[at[j] : at[j] + length].tobytes()
            if key in seen:
                again[[j, seen[key]]] = True
            seen.setdefault(key, j)
    return owner, start, again, suffixes.hashes(at, length), _OTHER.span(_OTHER.prefix(suffixes.bytes), at, at + length)


def _runs(start: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Window starts, ascending, as covered stretches."""
    if not len(start):
        return []
    cut = np.flatnonzero(np.diff(start) > length)
    return list(zip(start[np.append(0, cut + 1)].tolist(), (start[np.append(cut, len(start) - 1)] + length).tolist(), strict=True))


#: An id, and whether there is one: null ids are joined like others.
_ID = "struct<known: boolean, id: long>"
_SPANS = "digest binary, a long, b long, h1 long, h2 long, open boolean"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "a", "b", "h1", "h2", "open"])


def _sorted_groups(batches, length: int, most: int):
    """Rows of one partition in the order of (key, salt) -> spans; whole groups are worked on together, `most` bytes of
    contexts at a time."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "salt", "digest", "lo", "hi", "x", "done", "context")]
        for row in zip(*columns, strict=True):
            if row[7] is None:
                held.append(row)  # decided where it was cut
                continue
            if size > most and held and held[-1][:2] != row[:2]:
                yield from _settle(held, length)
                held, size = [], 0
            held.append(row)
            size += len(row[7])
    if held:
        yield from _settle(held, length)


def _settle(rows: list[tuple], length: int):
    found: list[tuple] = []
    classes: dict[tuple, list[tuple]] = {}
    for row in rows:
        key, salt, digest, lo, hi, x, _, context = row
        if context is None:
            found.append((digest, lo, hi + length, None, None, False))
        else:
            classes.setdefault((key, salt, context, x - lo), []).append(row)
    names = list(classes)
    members = list(classes.values())
    whole = [len(m) > 1 or m[0][6] for m in members]  # equal contexts: all windows repeat
    found += [(r[2], r[3], r[4] + length, None, None, False) for m, w in zip(members, whole, strict=True) if w for r in m]
    groups = {k: i for i, k in enumerate(dict.fromkeys(n[:2] for n in names))}
    group = np.array([groups[n[:2]] for n in names], np.int64)
    alone = np.bincount(group, minlength=len(groups))[group] == 1 if len(names) else np.empty(0, bool)
    salted = np.array([n[1] is not None for n in names], bool)
    take = np.flatnonzero(~alone | salted)
    if len(take):
        width = np.array([len(names[i][2]) - length for i in take], np.int64)
        owner, start, again, h1, h2 = repeats([names[i][2] for i in take], group[take], np.array([names[i][3] for i in take], np.int64), width, length)
        spread = np.flatnonzero(again)
        spread = spread[np.lexsort((start[spread], owner[spread]))]
        for part in np.split(spread, np.flatnonzero(np.diff(owner[spread])) + 1):
            if len(part) and not whole[take[owner[part[0]]]]:
                row = members[take[owner[part[0]]]][0]
                found += [(row[2], row[3] + a, row[3] + b, None, None, False) for a, b in _runs(start[part], length)]
        # Salted parts pass on one of each different window, open if nothing equal was seen here.
        pass_on = np.flatnonzero(salted[take][owner])
        if len(pass_on):
            order = pass_on[np.lexsort((h2[pass_on], h1[pass_on], group[take][owner[pass_on]]))]
            differ = np.append(True, np.diff(h1[order].view(np.int64)) != 0) | np.append(True, np.diff(h2[order].view(np.int64)) != 0) | np.append(True, np.diff(group[take][owner[order]]) != 0)
            for j in order[differ].tolist():
                row = members[take[owner[j]]][0]
                at = row[3] + int(start[j])
                closed = bool(again[j]) or whole[take[owner[j]]]
                found.append((row[2], at, at + length, int(h1[j : j + 1].view(np.int64)[0]), int(h2[j : j + 1].view(np.int64)[0]), not closed))
    for a in range(0, len(found), 50_000):
        yield _spans(found[a : a + 50_000])


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 200, hot: int = 2000) -> tuple[DataFrame, DataFrame]:
    """docs (id, text) -> (digest, spans) of the texts that lose bytes, spans being [a, b) in any order."""
    keyed = docs.select(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id")).alias("id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("body"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("body", 256)))

    def find(batches):
        for batch in batches:
            ids, digests, bodies = batch.column("id"), batch.column("digest"), batch.column("body").to_pylist()
            for a, b in slices(bodies, 1 << 20):
                found = anchors(bodies[a:b], length)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        digests.slice(a, b - a),
                        pa.array([len(t) for t in bodies[a:b]], pa.int64()),
                        pa.array([f[0].tobytes() for f in found], pa.binary()),
                        pa.array([np.array(f[1:]).astype("<i4").tobytes() for f in found], pa.binary()),
                    ],
                    names=["id", "digest", "size", "keys", "at"],
                )

    found = scratch.stage(keyed.mapInArrow(freed(find), f"id {_ID}, digest binary, size long, keys binary, at binary"), "anchors")
    texts = found.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"))
    texts = scratch.stage(texts, "texts")

    def spread(batches):
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
            at = [np.frombuffer(x, "<i4").reshape(3, -1) for x in batch.column("at").to_pylist()]
            n = [len(k) for k in keys]
            if sum(n):
                x, lo, hi = np.concatenate(at, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), batch.column("id").take(pa.array(np.repeat(np.arange(len(n)), n))), batch.column("digest").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(x), pa.array(lo), pa.array(hi)],
                    names=["key", "id", "digest", "x", "lo", "hi"],
                )

    # One row of each different text: equal rows of one id and text are told apart by nothing and count once.
    first = found.join(texts.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    each = first.select("id", "digest", "keys", "at").mapInArrow(freed(spread), f"key long, id {_ID}, digest binary, x int, lo int, hi int")
    each = scratch.stage(each, "each")
    scratch.drop("anchors")
    often = scratch.stage(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # Keys with more than a share of all anchors are no more than its inverse: these are broadcast and never gather.
    much = F.lit(max(hot, each.count() // _FREQUENT))
    frequent = F.broadcast(often.where(F.col("n") > much))
    rest = each.join(frequent.select("key"), "key", "left_anti").join(often.where(F.col("n") <= much), "key")
    wanted = each.join(frequent, "key").unionByName(rest).groupBy("id", "digest").agg(F.collect_list(F.struct("key", "n", "x", "lo", "hi")).alias("wanted"))
    wanted = scratch.stage(wanted, "wanted")
    scratch.drop("each")

    def cut(batches):
        for batch in batches:
            rows: dict[tuple, list] = {}
            done = []
            for digest, body, own in zip(*(batch.column(c).to_pylist() for c in ("digest", "body", "wanted")), strict=True):
                for w in own:
                    salt = None if w["n"] <= hot else int.from_bytes(digest[:4], "big") % -(-w["n"] // hot)
                    context = body[w["lo"] : w["hi"] + length]
                    row = (w["key"], salt, digest, w["lo"], w["hi"], w["x"])
                    name = (w["key"], salt, context, w["x"] - w["lo"])
                    if name in rows:  # an equal context in this batch: both are decided, one goes on for others
                        rows[name][6] = True
                        done.append((*row, True, None))
                    else:
                        rows[name] = [*row, False, context]
            columns = list(zip(*rows.values(), *done, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "salt", "digest", "lo", "hi", "x", "done", "context"])

    contexts = keyed.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("digest", "body", "wanted")
    contexts = contexts.mapInArrow(freed(cut), "key long, salt int, digest binary, lo int, hi int, x int, done boolean, context binary")
    contexts = contexts.repartition("key", "salt").sortWithinPartitions("key", "salt")
    spans = scratch.stage(contexts.mapInArrow(freed(lambda batches: _sorted_groups(batches, length, 1 << 20)), _SPANS), "spans")
    passed = spans.where("h1 is not null")
    # One row of each window and part: as many as a key has parts, however hot it is.
    rows = F.collect_list(F.struct("digest", "a", "open"))
    across = passed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("open").alias("some"), rows.alias("rows")).where("n > 1 and some")
    across = scratch.stage(across.select("h1", "h2", F.explode("rows").alias("s")).select("h1", "h2", "s.*"), "across")
    across = _same_windows(across, keyed, texts, length, scratch) if across.limit(1).count() else across.select("digest", "a", F.col("a").alias("b")).limit(0)
    copied = texts.where(F.col("copies") > 1).where(F.col("size") >= length).select("digest", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    all_spans = spans.where("h1 is null").select("digest", "a", "b").unionByName(across).unionByName(copied)
    grouped = all_spans.groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return keyed, scratch.stage(grouped, "grouped")


def _same_windows(rows: DataFrame, keyed: DataFrame, texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """digest, a, b of the open rows (h1, h2, digest, a, open) whose bytes another row of the same hashes has as well."""
    own = rows.groupBy("digest").agg(F.collect_list(F.struct("h1", "h2", "a", "open")).alias("own")).join(texts.select("digest", "id"), "digest")

    def cut(batches):
        for batch in batches:
            for digest, body, own in zip(*(batch.column(c).to_pylist() for c in ("digest", "body", "own")), strict=True):
                for i in range(0, len(own), 1 << 14):
                    part = own[i : i + (1 << 14)]
                    columns = [pa.array([w[c] for w in part], k) for c, k in (("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int64()), ("open", pa.bool_()))]
                    columns += [pa.array([digest] * len(part), pa.binary()), pa.array([body[w["a"] : w["a"] + length] for w in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "a", "open", "digest", "window"])

    found = keyed.join(own, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("digest", "body", "own")
    found = found.mapInArrow(cut, "h1 long, h2 long, a long, open boolean, digest binary, window binary")
    same = found.groupBy("h1", "h2", "window").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("open"), F.struct("digest", "a"))).alias("open"))
    same = same.where("n > 1").select(F.explode("open").alias("s")).select("s.*")
    return scratch.stage(same.withColumn("b", F.col("a") + length), "same")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = 2000, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, with keep_bytes, kept (the bytes that stay)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed, spans = repeated_spans(rows, scratch, length, hot)

    def apply(batches):
        for batch in batches:
            out = []
            for i, body, own in zip(*(batch.column(c).to_pylist() for c in ("id", "body", "spans")), strict=True):
                gone = _merged((s["a"], s["b"]) for s in own or [])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(body[at:a])
                    at = b
                kept = b"".join([*kept, body[at:]])
                out.append((i["id"] if i["known"] else None, len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in gone], kept if keep_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    joined = keyed.join(spans, "digest", "left").select("id", "body", "spans")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: long, b: long>>, kept binary")
