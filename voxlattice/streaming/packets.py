"""The packet operators as streams: duplicates within a watermark, sliding frames, and concealment with state.

The batch rule for late packets needs a stream's least arrival of all; a stream can only take the first it sees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(spark: SparkSession, table: DataFrame, folder: str) -> DataFrame:
    """A table as a stream of its files."""
    table.write.mode("append").parquet(folder)
    return spark.readStream.schema(table.schema).parquet(folder)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What the stream emits once all its input is read. State is kept in RocksDB, outside the heap."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def in_turn(spark: SparkSession, slices: list[DataFrame], through: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a stream emits for tables that arrive one after the other; each is a run that takes up the state where the
    run before has left it."""
    for part in slices:
        out = drained(through(replay(spark, part, f"{folder}/in")), folder)
    return out


def without_repeats(packets: DataFrame, delay: str = "30 days") -> DataFrame:
    return packets.withWatermark("arrival", delay).dropDuplicatesWithinWatermark(["ssrc", "seq"])


def sliding_counts(packets: DataFrame, length: str, step: str, delay: str) -> DataFrame:
    frames = packets.withWatermark("arrival", delay).groupBy("ssrc", F.window("arrival", length, step))
    return frames.agg(F.count("*").alias("n")).select("ssrc", F.col("window.start").alias("start"), "n")


def concealing(packets: DataFrame) -> DataFrame:
    """ssrc, seq, out: packets in the order of seq within each batch; a gap repeats the last good value. State is the
    next seq and the last value of each ssrc."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, last = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["seq", "arrival", "event_id"]).drop_duplicates("seq")
        out = []
        for seq, value in zip(rows["seq"].tolist(), rows["value"].tolist(), strict=True):
            if seq < due:
                continue
            out += [(key[0], s, last) for s in range(due, seq)]
            out.append((key[0], seq, value))
            due, last = seq + 1, value
        state.update((due, last))
        yield pd.DataFrame(out, columns=["ssrc", "seq", "out"])

    return packets.groupBy("ssrc").applyInPandasWithState(step, "ssrc long, seq int, out double", "due int, last double", "append", GroupStateTimeout.NoTimeout)
