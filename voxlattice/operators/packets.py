"""Packet streams: first arrivals, late packets, gaps, concealment, loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_arrivals(packets: DataFrame) -> DataFrame:
    """One row of each (ssrc, seq), that of the first arrival: a partial aggregate, no window."""
    best = F.min_by(F.struct("arrival", "event_id", "value"), F.struct("arrival", "event_id")).alias("p")
    return packets.groupBy("ssrc", "seq").agg(best).select("ssrc", "seq", "p.*")


def marked_late(packets: DataFrame, playout_seconds: int, frame_seconds: int) -> DataFrame:
    """first arrivals with late: after the stream's first arrival, the playout delay and the frames before."""
    start = packets.groupBy("ssrc").agg(F.min("arrival").alias("anchor"))
    due = F.unix_micros("anchor") + (playout_seconds + F.col("seq") * frame_seconds) * F.lit(1_000_000)
    return packets.join(start, "ssrc").withColumn("late", F.unix_micros("arrival") > due).drop("anchor")


def spine(packets: DataFrame) -> DataFrame:
    """Every seq of each stream up to its last, with state ok, late or missing."""
    last = packets.groupBy("ssrc").agg(F.max("seq").alias("last"))
    every = last.select("ssrc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("seq"))
    state = F.when(F.col("late").isNull(), "missing").when(F.col("late"), "late").otherwise("ok")
    return every.join(packets, ["ssrc", "seq"], "left").withColumn("state", state)


def concealed(frames: DataFrame) -> DataFrame:
    """frames of spine() with out: the value, or the last good one before it (0 at first); late frames do not count."""
    good = F.when(F.col("state") == "ok", F.col("value"))
    before = W.partitionBy("ssrc").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("out", F.coalesce(F.last(good, ignorenulls=True).over(before), F.lit(0.0)))


def lab_gates(rows: DataFrame) -> DataFrame:
    """gate, value, passed: of scenarios clean, loss1 and loss10 (rows: scenario, loss in percent, mos)."""
    of = lambda name, x: F.avg(F.when(F.col("scenario") == name, F.col(x)))
    found = rows.agg(of("clean", "mos").alias("clean"), F.max(F.when(F.col("scenario") == "clean", F.col("loss"))).alias("lost"), (of("loss10", "mos") - of("loss1", "mos")).alias("gain"))
    gates = [("clean_mos", "clean", F.col("clean") >= 4.4), ("clean_loss", "lost", F.col("lost") == 0), ("loss_order", "gain", F.col("gain") <= 0.15)]
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.round(c, 6).alias("value"), p.alias("passed")) for n, c, p in gates])).alias("g")).select("g.*")
