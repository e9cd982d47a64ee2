"""Mixing sources to target weights, with DataFrame functions alone.

Each source gets a target number of words. Its rows fall into `blocks` blocks by hash, so that no source sits in one
task; a block is what is drawn. A source's quota is so many whole passes over its blocks, then permuted blocks up to
the target, the last of them in part (rows up to a hash bound). A splitting tree then deals the exact quotas of blocks
to output shards: each node halves its shards and draws, source by source, how many of its blocks go left from the
hypergeometric law (inverse of the distribution function, computed in SQL). A source's drawn blocks, in permuted order,
are cut at the quotas, so shards hold disjoint blocks. Rows are shuffled within their shard by a keyed hash.

What is joined to the rows is one line for each (source, block): broadcast only if the number of sources, which is
counted first, keeps it small; joined by shuffle otherwise, on keys that split the hottest source `blocks` ways.

Rows are drawn by a hash of id and text. Equal rows share it; of those at the bound of the block that is drawn in part,
the number is taken that leaves the source nearest to its target, whichever they are.

Defined results: null text has size 0; a null source is a source of its own, after all others; an empty table gives no
rows; rows that share an id but not a text are drawn apart; equal rows are separate rows; rows of size 0 count as part
of their block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, uniform

#: Blocks of a source, at least, and rows for which there is one block more; lines of the block table up to which it may
#: be broadcast (about 60 bytes each); words of an output partition.
BLOCKS, BLOCK_ROWS, BROADCAST_LINES, PART_WORDS = 256, 1 << 20, 1 << 16, 4_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size -> and target: shares of all sizes by weight, stopped at `most` times the source's size, the
    excess reshared by weight. Sources in the order of bound / weight stop first, so running sums give the level."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    out = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    out = out.withColumn("bound", F.lit(most) * F.col("source_size"))
    rising = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    stopped = F.coalesce(F.sum("bound").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("words", F.sum("source_size").over(everything)).withColumn("level", (F.col("words") - stopped) / left)
    # The first source that its share does not stop sets the level for all after it; of those alike in bound / weight, too.
    out = out.withColumn("turn", F.row_number().over(rising))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct("turn", "level"))).over(everything)["level"]
    share = F.when(level.isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), level * F.col("weight")))
    return out.withColumn("target", share.cast("double")).select("source", "source_size", "target")


def _ln_choose(n: Column, k: Column) -> Column:
    few = F.least(k, n - k)
    step = lambda s, i: s + F.when(i > 0, F.ln((n - few + i).cast("double") / i)).otherwise(0.0)
    return F.aggregate(F.sequence(F.lit(0).cast("long"), few), F.lit(0.0), step)


def _draw(own: Column, drawn: Column, total: Column, u: Column) -> Column:
    """How many of `own` marked blocks are among `drawn` of `total`: the inverse at u of the hypergeometric distribution
    function, its terms taken from one another in logarithms."""
    other = total - own
    low, high = F.greatest(F.lit(0).cast("long"), drawn - other), F.least(own, drawn)
    first = _ln_choose(own, low) + _ln_choose(other, drawn - low) - _ln_choose(total, drawn)

    def term(s, k):
        on = s["below"] <= u
        up = F.ln((own - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (other - drawn + k + 1)))
        return F.struct(
            F.when(on, k).otherwise(s["got"]).alias("got"),
            F.when(on, s["below"] + F.exp(s["log_p"])).otherwise(s["below"]).alias("below"),
            F.when(k < high, s["log_p"] + up).otherwise(s["log_p"]).alias("log_p"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("got"), F.lit(0.0).alias("below"), first.alias("log_p"))
    return F.aggregate(F.sequence(low, high), zero, term, lambda s: s["got"])


def split(quotas: DataFrame, shards: int, seed: str, scratch: Scratch) -> DataFrame:
    """source_no, units -> shard, source_no, units: the splitting tree, a level at a time. A node is one row with the
    array of its sources' quotas; its left half takes in each source, one after the other, what the law says given
    how many blocks still go left (`need`) and how many this and later sources have (`rest`)."""
    add = lambda s, x: s + x
    zero = F.lit(0).cast("long")
    q = F.transform(F.array_sort(F.collect_list(F.struct("source_no", "units"))), lambda x: x["units"])
    node = quotas.groupBy().agg(q.alias("q")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "q")
    while shards > 1:
        low, mid, high = F.col("low"), F.floor((F.col("low") + F.col("high")) / 2).cast("int"), F.col("high")
        whole = F.aggregate("q", zero, add)
        node = node.withColumn("mid", mid).withColumn("total", whole)
        node = node.withColumn("goes", F.round(F.col("total") * (F.col("mid") - low).cast("double") / (high - low)).cast("long"))

        def deal(acc, e):
            u = uniform(F.lit(seed), F.col("low"), F.col("high"), e["n"]) / F.lit(float(1 << 60))
            need = F.col("goes") - F.aggregate(acc["got"], zero, add)
            return F.struct((acc["rest"] - e["own"]).alias("rest"), F.concat(acc["got"], F.array(_draw(e["own"], need, acc["rest"], u))).alias("got"))

        start = F.struct(F.col("total").alias("rest"), F.array().cast("array<bigint>").alias("got"))
        numbered = F.transform("q", lambda x, i: F.struct(x.alias("own"), i.alias("n")))
        one = high - low <= 1
        node = node.withColumn("left", F.when(one, F.col("q")).otherwise(F.aggregate(numbered, start, deal, lambda s: s["got"])))
        node = scratch.stage(node, f"level{shards}")  # a level's draws must not be folded into the next one's
        right = node.where(~one).select(F.col("mid").alias("low"), "high", F.zip_with("q", "left", lambda x, y: x - y).alias("q"))
        node = node.select("low", F.when(one, high).otherwise(F.col("mid")).alias("high"), F.col("left").alias("q")).unionByName(right)
        shards = (shards + 1) // 2
    return node.select(F.col("low").alias("shard"), F.posexplode("q").alias("source_no", "units"))


def mixing_plan(
    docs: DataFrame,
    scratch: Scratch,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    shards: int = 16,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    least_blocks: int = BLOCKS,
) -> DataFrame:
    """The rows of docs with size, source_size, target, shards (the output shard of each time the row is taken) and
    mix_hash."""
    keyed = docs.withColumns({"size": words(F.col(text_col)), "mix_hash": uniform(F.lit(seed), F.col(id_col), F.md5(F.col(text_col)))})
    slim = scratch.stage(keyed.select(F.col(source_col).alias("source"), "size", "mix_hash"), "sizes")
    blocks = least_blocks
    while blocks * BLOCK_ROWS < slim.count():
        blocks *= 2
    in_block = lambda h: (h % blocks).cast("int")
    keyed, slim = (x.withColumn("mix_block", in_block(F.col("mix_hash"))) for x in (keyed, slim))

    sized = slim.groupBy("source", "mix_block").agg(F.sum("size").alias("words"))
    sources = targets(sized.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    sources = sources.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = scratch.stage(sources.withColumn("passes", whole).withColumn("rest", F.col("target") - whole * F.col("source_size")), "sources")

    same = sized["source"].eqNullSafe(sources["source"])
    block = sized.join(sources, same).select(sources["*"], "mix_block", "words")
    order = Window.partitionBy("source_no").orderBy(uniform(F.lit(seed), F.lit("block"), F.col("source_no"), F.col("mix_block")), "mix_block")
    block = block.withColumn("upto", F.sum("words").over(order)).withColumn("gap", F.col("rest") - F.col("upto") + F.col("words"))
    block = block.withColumn("drawn", F.col("upto") <= F.col("rest")).withColumn("parted", ~F.col("drawn") & (F.col("gap") > 0))
    # Of the block at the edge, the rows up to the hash bound that leaves the source nearest to its target.
    edge = block.where("parted").select(F.col("source").alias("edge_source"), F.col("mix_block").alias("edge_block"), "gap")
    inside = slim.join(edge, slim["source"].eqNullSafe(F.col("edge_source")) & (F.col("mix_block") == F.col("edge_block")))
    # Equal hashes are one line with a number of rows: a group of equal rows is not sorted.
    inside = inside.groupBy("source", "mix_hash", "gap").agg(F.max("size").alias("each"), F.count("*").alias("n"), F.sum("size").alias("all"))
    before = F.sum("all").over(Window.partitionBy("source").orderBy("mix_hash")) - F.col("all")
    # As many rows of a line as leave the source nearest: those whose middle is within the gap.
    fit = F.floor((F.col("gap") - before) / F.col("each") + 0.5)
    inside = inside.withColumn("fit", F.when(F.col("each") > 0, F.least(F.greatest(fit, F.lit(0)), F.col("n"))).when(before <= F.col("gap"), F.col("n")).otherwise(0).cast("long"))
    last = F.max(F.when(F.col("fit") > 0, F.struct("mix_hash", "fit", "n")))
    bound = inside.groupBy(F.col("source").alias("edge_source")).agg(last.alias("last")).where("last is not null")
    bound = bound.select("edge_source", F.col("last.mix_hash").alias("bound"), (F.col("last.n") > F.col("last.fit")).alias("tied"), F.col("last.fit").alias("fit"))
    block = scratch.stage(block.join(bound, block["source"].eqNullSafe(F.col("edge_source")) & F.col("parted"), "left").drop("edge_source"), "blocks")

    # What is dealt to shards: a block for each whole pass, once more if it is drawn, and the part of the one at the edge.
    again = F.col("drawn") | F.col("bound").isNotNull()
    takes = F.when(again, F.sequence(F.lit(0), F.col("passes"))).when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1))
    units = block.withColumn("take", F.explode(takes))
    units = units.select("source_no", "mix_block", "take", (F.col("parted") & (F.col("take") == F.col("passes"))).alias("in_part"))
    permuted = Window.partitionBy("source_no").orderBy(uniform(F.lit(seed), F.lit("unit"), F.col("source_no"), F.col("mix_block"), F.col("take")), "mix_block", "take")
    units = units.withColumn("at", F.row_number().over(permuted))
    quotas = scratch.stage(split(units.groupBy("source_no").agg(F.count("*").alias("units")), shards, seed, scratch), "quotas")
    # split() numbers the sources that have units from 0 on, in their order.
    named = units.select("source_no").distinct().select(F.col("source_no").alias("of"), (F.row_number().over(Window.orderBy("source_no")) - 1).alias("source_no"))
    upto = F.sum("units").over(Window.partitionBy("source_no").orderBy("shard"))
    quotas = quotas.withColumn("upto", upto).join(named, "source_no").select(F.col("of").alias("source_no"), "shard", "upto", (F.col("upto") - F.col("units")).alias("past"))
    dealt = units.join(quotas, "source_no").where("at > past and at <= upto")
    dealt = dealt.groupBy("source_no", "mix_block").agg(
        F.sort_array(F.collect_list(F.when(~F.col("in_part"), F.col("shard")))).alias("whole"), F.max(F.when(F.col("in_part"), F.col("shard"))).alias("part")
    )
    lines = block.select(F.col("source").alias("of_source"), F.col("mix_block").alias("of_block"), "source_no", "source_size", "target", "bound", "tied", "fit")
    lines = lines.join(dealt, (lines["source_no"] == dealt["source_no"]) & (lines["of_block"] == dealt["mix_block"]), "left")
    lines = scratch.stage(lines.select("of_source", "of_block", "source_size", "target", "bound", "tied", "fit", "whole", "part"), "lines")

    n, ties = lines.agg(F.count("*"), F.count_if("tied")).first()
    if n <= BROADCAST_LINES:
        lines = F.broadcast(lines)
    out = keyed.join(lines, F.col(source_col).eqNullSafe(F.col("of_source")) & (F.col("mix_block") == F.col("of_block")))
    taken = F.coalesce("whole", F.array().cast("array<int>"))
    none = F.array().cast("array<int>")

    def decided(rows: DataFrame, partly: Column) -> DataFrame:
        rows = rows.withColumn("shards", F.concat(taken, F.when(F.col("part").isNotNull() & partly, F.array("part")).otherwise(none)))
        return rows.select(*docs.columns, "size", "source_size", "target", "shards", "mix_hash")

    if not ties:
        return decided(out, F.col("mix_hash") <= F.col("bound"))
    # Equal rows at a bound, of which some are taken: they are told apart by their place in the input.
    at_bound = F.coalesce(F.col("tied") & (F.col("mix_hash") == F.col("bound")), F.lit(False))
    equal = scratch.stage(out.where(at_bound).withColumn("mix_place", F.monotonically_increasing_id()), "ties")
    few = F.row_number().over(Window.partitionBy("of_source").orderBy("mix_place")) <= F.col("fit")
    chosen = equal.withColumn("mix_few", few)
    return decided(out.where(~at_bound), F.col("mix_hash") <= F.col("bound")).unionByName(decided(chosen, F.col("mix_few")))


def mix_sources(docs: DataFrame, shards: int = 16, seed: str = "mix", part_words: int = PART_WORDS, **options) -> DataFrame:
    """The mix: the columns of docs, whatever their names, a row as often as it is taken. Each shard has partitions of its
    own, as many as its words ask for; within a shard rows stand in the order of a keyed hash."""
    scratch = Scratch(docs.sparkSession, "mixing")
    # A row travels as one column: no name of its columns meets one of the plan's.
    named = {c: options.pop(c, d) for c, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    rows = docs.select(F.struct(*docs.columns).alias("mix_row"), *[F.col(v).alias(f"mix_{k}") for k, v in named.items()])
    plan = mixing_plan(rows, scratch, shards=shards, seed=seed, **{k: f"mix_{k}" for k in named}, **options)
    # What is taken is known before any text moves: all sizes, near enough.
    total = scratch.read("sizes").agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-total // (part_words * shards)))
    mixed = plan.select("mix_row", "mix_hash", F.posexplode("shards").alias("mix_take", "mix_shard"))
    mixed = mixed.withColumn("mix_order", uniform(F.lit(seed), F.col("mix_hash"), F.col("mix_take")))
    # A shard's partitions are stretches of its order, and each has its number.
    part = F.col("mix_shard") * each + F.least((F.col("mix_order") / (float(1 << 60) / each)).cast("int"), F.lit(each - 1))
    return mixed.repartitionById(shards * each, part).sortWithinPartitions("mix_order").select("mix_row.*")
