"""Near-duplicate texts: a multi-index Hamming join of b-bit minwise signatures, confirmed on full shingle sets.

A document's signature holds `SYMBOLS` minwise values of `BITS` bits; its distance to another is the number of symbols
that differ. The signature is split into chunks, and the allowed distance is shared out by the pigeonhole principle:
chunk i may hold `errors[i]` wrong symbols with sum(errors[i] + 1) > distance, so every pair within the distance agrees
in some chunk up to that chunk's errors. A document has a key for each way to leave those symbols out, and pairs within
the distance are guaranteed to share a key. (A pair of similarity 0.8 is beyond the distance with odds below 1e-4.)

Equal texts (by SHA-256) are first folded into one class, a node of its own, whatever the ids of its rows. No key's documents are ever collected or paired with each
other: each meets the key's pivot (one aggregate a key), links are confirmed on the full sets, components are formed,
and only keys that still hold several components go on, with pivots drawn anew for each key; what is left after a few
rounds, documents of different components under one key, is compared in full: blocks of a key's documents meet in pairs,
each pair of blocks in one task, and those of the largest component are not compared with each other. So no link between
components is lost, and neither a key nor a group of near copies lands in one task.

Pairs are sifted by a bound before any text is read: a set's parity sketch holds, for each of PARITIES bins of hashes,
whether an odd number of shingles fell into it. Two sketches differ in no more bins than the sets differ in shingles, so
a pair whose sketches differ more than the similarity allows cannot be similar; none that is similar is turned away.

Defined results: words are runs without white space, ASCII letters in lower case; a text with fewer words than a
shingle is one shingle; null and blank texts have no shingles, link with nothing and stay; rows with a null id are
never linked and always kept; equal rows share a class, and every row of the smallest id is kept; rows of one id with
different texts are linked each by its own text (drop_near_duplicates() keeps one row of a group, and of rows that
share an id those whose groups differ); an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Powers, Scratch, freed, mix, slices
from .components import components

SYMBOLS, BITS, CHUNK, DISTANCE, PARITIES = 64, 19, 4, 26, 1024
#: Groups of the pairs of one text.
SPREAD = 1024
#: Three symbols of 20 bits (one to spare) in each long.
LANES, LONGS = 3, -(-SYMBOLS // 3)
_POWERS = Powers()
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted different 64-bit hashes of each text's shingles."""
    joined = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(begin):
        end = end[len(end) - len(begin) :]
    word = mix(_POWERS.span(_POWERS.prefix(joined), begin, end) ^ (end - begin).astype(np.uint64))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(begin, starts)
    out = []
    rolled = _rolled(word, width)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        else:
            out.append(_rolled(word[a:b], int(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def _rolled(word: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(word) - width + 1)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n])
    return h


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minwise values of BITS bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, a : a + 4096] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    return mix(least) & np.uint64((1 << BITS) - 1)


def packed(symbols: np.ndarray) -> np.ndarray:
    """Symbols (documents x SYMBOLS) as LONGS longs."""
    wide = np.zeros((len(symbols), LONGS * LANES), np.uint64)
    wide[:, :SYMBOLS] = symbols
    wide = wide.reshape(len(symbols), LONGS, LANES)
    return (wide << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS + 1))).sum(2, dtype=np.uint64).astype(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls into each of PARITIES bins, as longs."""
    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def unpacked(longs: np.ndarray) -> np.ndarray:
    lanes = longs.astype(np.uint64)[:, :, None] >> (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS + 1))
    return (lanes & np.uint64((1 << BITS) - 1)).reshape(len(longs), -1)[:, :SYMBOLS]


def shared_errors(distance: int, chunks: int) -> list[int]:
    """How many symbols of each chunk may be wrong: the least with sum(errors + 1) > distance."""
    each, more = divmod(distance + 1, chunks)
    return [each - 1 + (i < more) for i in range(chunks)]


def keys(symbols: np.ndarray) -> np.ndarray:
    """(documents x keys): for each chunk, a hash of its symbols with each choice of allowed errors left out."""
    out = []
    for chunk, errors in enumerate(shared_errors(DISTANCE, SYMBOLS // CHUNK)):
        if errors < 0:
            continue
        for kept in combinations(range(CHUNK), CHUNK - errors):
            h = np.full(len(symbols), (chunk << 8) | sum(1 << k for k in kept), np.uint64)
            for k in kept:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + symbols[:, chunk * CHUNK + k])
            out.append(h)
    return np.array(out).T.astype(np.int64)


def distance(a: Column, b: Column) -> Column:
    """The number of symbols in which two packed signatures differ."""
    ones = sum(((1 << BITS) - 1) << (lane * (BITS + 1)) for lane in range(LANES))
    tops = sum(1 << BITS << (lane * (BITS + 1)) for lane in range(LANES))
    # A lane that is not zero carries into its spare bit when all ones are added.
    parts = [F.bit_count((F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) + F.lit(ones)).bitwiseAND(F.lit(tops))) for i in range(LONGS)]
    return sum(parts[1:], parts[0])


def possible(a: Column, b: Column, percent: int) -> Column:
    """Whether two signed sets (structs of n, sig and odd) are within the signature distance and can be similar."""
    apart = [F.bit_count(F.get(a["odd"], F.lit(i)).bitwiseXOR(F.get(b["odd"], F.lit(i)))) for i in range(PARITIES // 64)]
    # |A - B| + |B - A| <= (|A| + |B|) (1 - s) / (1 + s) for sets of similarity s.
    bound = sum(apart[1:], apart[0]) * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent)
    return bound & (distance(a["sig"], b["sig"]) <= DISTANCE)


@lru_cache(32)
def _set(text: str, width: int) -> frozenset:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else frozenset({tuple(words)} if words else ())


def similar(a: str, b: str, width: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    x, y = _set(a, width), _set(b, width)
    both = len(x & y)
    return bool(x and y) and 100 * both >= percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, n, digest, sig and odd of each row of docs (id, digest, text); a text without words has no sig."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
            for a, b in slices(texts, 1 << 20):
                sets = shingle_hashes(texts[a:b], width)
                sigs = packed(np.array([signature(h) for h in sets]))
                full = [len(h) > 0 for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(h) for h in sets], pa.int64()),
                        batch.column(1).slice(a, b - a),
                        pa.array([s.tolist() if f else None for s, f in zip(sigs, full, strict=True)], pa.list_(pa.int64())),
                        pa.array([parities(h).tolist() if f else None for h, f in zip(sets, full, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "digest", "sig", "odd"],
                )

    return docs.mapInArrow(freed(run), "id long, n long, digest binary, sig array<long>, odd array<long>")


def _linked(docs: DataFrame, width: int, percent: int, rounds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs (id, text) -> signed rows (id, n, digest, ...), and of each class (digest) its smallest id (rep), its component,
    and the component's smallest id and the digest that it stands for."""
    texts = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).select("id", "digest", "text")
    signed = scratch.stage(signatures(texts, width), "signed")
    classes = signed.where("n > 0 and id is not null").groupBy("digest").agg(F.min_by(F.struct("id", "n", "sig", "odd"), "id").alias("s"))
    # A class's number is fixed once it is written.
    classes = classes.select(F.monotonically_increasing_id().alias("class"), "digest", F.col("s.id").alias("rep"), "s.n", "s.sig", "s.odd")
    classes = scratch.stage(classes, "classes")

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                found = keys(unpacked(np.array(batch.column(1).to_pylist(), np.int64).reshape(batch.num_rows, LONGS)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), found.shape[1])), pa.array(found.ravel())], names=["id", "key"])

    keyed = classes.select(F.col("class").alias("id"), "sig").mapInArrow(freed(spread), "id long, key long")
    shared = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).where("pivot != most").select("key", "pivot")
    shared = scratch.stage(shared, "shared")
    held = scratch.stage(keyed.join(shared, "key"), "held")  # (key, id, pivot) of keys with several classes
    signed_ = lambda name: scratch.read("classes").select(F.col("class").alias("id"), F.struct("n", "sig", "odd").alias(name))

    def within(pairs: DataFrame) -> DataFrame:
        a, b = signed_("sa").withColumnRenamed("id", "a"), signed_("sb").withColumnRenamed("id", "b")
        return pairs.join(a, "a").join(b, "b").where(possible(F.col("sa"), F.col("sb"), percent)).select("a", "b")

    near = within(held.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    tested = scratch.stage(near, "near0")

    # The texts that any later round may ask for, moved once.
    wanted = scratch.read("held").select(F.col("id").alias("class")).distinct().join(scratch.read("classes").select("class", F.col("rep").alias("id"), "digest"), "class")
    own = scratch.stage(texts.join(wanted, ["id", "digest"]).select(F.col("class").alias("id"), "text").dropDuplicates(["id"]), "texts")
    links = scratch.stage(_confirmed(tested, own, width, percent), "links0")
    named = scratch.stage(components(links, scratch, "stars0-"), "named0")
    for turn in range(1, rounds + 2):
        open_ = scratch.stage(_undecided(scratch.read("held").select("key", "id"), named), f"open{turn}")
        if not open_.limit(1).count():
            break
        if turn <= rounds:
            draw = F.xxhash64("id", "key", F.lit(turn))
            pivots = open_.groupBy("key").agg(F.min_by(F.struct("id", "component"), draw).alias("p"))
            pairs = open_.join(pivots, "key").where("component != p.component").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
            near = within(pairs.distinct())
        else:
            near = across(open_.join(signed_("s"), "id").select("key", "id", "component", "s.*"), percent).distinct()
        fresh = scratch.stage(near.join(tested, ["a", "b"], "left_anti"), f"near{turn}")
        tested = tested.unionByName(fresh)
        found = scratch.stage(_confirmed(fresh, own, width, percent), f"links{turn}")
        if found.limit(1).count():
            links = links.unionByName(found)
            named = scratch.stage(components(links, scratch, f"stars{turn}-"), f"named{turn}")

    known = classes.join(named, classes["class"] == named["node"], "left").select("class", "digest", "rep", F.coalesce("component", "class").alias("component"))
    owner = known.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("owner"))
    return signed, scratch.stage(known.join(owner, "component").select("digest", "rep", "owner"), "known")


def shingle_links(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed, known = _linked(rows, width, percent, rounds, Scratch(docs.sparkSession, "shingles"))
    known = known.select(F.col("digest").alias("of"), F.col("owner.rep").alias("component_id"))
    out = signed.join(known, (F.col("digest") == F.col("of")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def across(rows: DataFrame, percent: int, block_rows: int = 2048) -> DataFrame:
    """a, b: the possible pairs of different components under one key (rows: key, id, component, n, sig, odd)."""
    large = rows.groupBy("key").count().where(F.col("count") > block_rows).select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "component", "n", "sig", "odd")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")], 1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(names)], strict=True):
                part = batch.slice(begin, end - begin)
                if held and begin == 0 and [held[-1].column(c)[0] for c in ("key", "lo", "hi")] == [part.column(c)[0] for c in ("key", "lo", "hi")]:
                    held.append(part)  # a group that goes on from the batch before
                else:
                    if held:
                        yield _possible_pairs(held, percent)
                    held = [part]
        if held:
            yield _possible_pairs(held, percent)

    ordered = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return ordered.mapInArrow(freed(run), "a long, b long")


def _possible_pairs(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """possible(), for the pairs of different components of one group (of two blocks: those between them)."""
    table = pa.Table.from_batches(parts)
    block, ids, component, n = (table.column(c).to_numpy() for c in ("block", "id", "component", "n"))
    flat = lambda c: np.concatenate([p.column(c).flatten().to_numpy() for p in parts]).reshape(len(ids), -1)
    names, number = np.unique(component, return_inverse=True)
    largest = number == np.bincount(number).argmax()
    found = []
    if len(names) > 1:
        odd, symbols = flat("odd").view(np.uint64), unpacked(flat("sig"))
        rest, step = np.flatnonzero(~largest), max(1, (1 << 22) // odd.size)
        for k in range(0, len(rest), step):
            i = rest[k : k + step]
            apart = np.bitwise_count(odd[i][:, None, :] ^ odd[None, :, :]).sum(2, dtype=np.int64)
            near = apart * (100 + percent) <= (n[i][:, None] + n[None, :]) * (100 - percent)
            near &= number[i][:, None] != number[None, :]
            near &= largest[None, :] | (ids[i][:, None] < ids[None, :])
            if block.min() != block.max():
                near &= block[i][:, None] != block[None, :]
            x, y = np.nonzero(near)
            x = i[x]
            close = (symbols[x] != symbols[y]).sum(1) <= DISTANCE
            found.append((ids[x[close]], ids[y[close]]))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _undecided(held: DataFrame, named: DataFrame) -> DataFrame:
    """key, id, component of the keys that hold more than one component."""
    rows = held.join(named, held["id"] == named["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_ = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key")
    return rows.join(open_, "key", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""

    def run(batches):
        for part in batches:
            yes = [similar(x, y, width, percent) for x, y in zip(part["ta"], part["tb"], strict=True)]
            yield part.loc[np.array(yes, bool), ["a", "b"]]

    # A text that many pairs share is sent once for each of SPREAD groups of them, not once for each.
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    first = pairs.select("a", "salt").distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(second, "b").join(first, ["a", "salt"]).select("a", "b", "ta", "tb").mapInPandas(freed(run), "a long, b long")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, one row of each group of near duplicates: of its smallest id, and of that id's text."""
    scratch = Scratch(docs.sparkSession, "shingles")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    signed, known = _linked(rows, width, percent, 1, scratch)
    known = known.select(F.col("digest").alias("of"), "owner")
    linked = signed.where("n > 0 and id is not null").select("id", "digest").join(known, F.col("digest") == F.col("of"))
    stays = (F.col("id") == F.col("owner.rep")) & (F.col("digest") == F.col("owner.digest"))
    gone = linked.where(~stays).select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    own = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    # A row travels as one column: no name of its columns meets one of ours.
    every = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("row_id"), own.alias("row_digest"))
    same = (F.col("row_id") == F.col("_id")) & (F.col("row_digest") == F.col("_digest"))
    rest = every.join(gone, same, "left_anti")
    again = scratch.stage(linked.where(stays).groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).count().where("count > 1").drop("count"), "again")
    if not again.limit(1).count():
        return rest.select("row.*")
    # Rows equal in id and text: one of them stays.
    one = rest.join(again, same).dropDuplicates(["_id", "_digest"]).select("row.*")
    return rest.join(again, same, "left_anti").select("row.*").unionByName(one)
