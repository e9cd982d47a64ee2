"""How the driver's tables stand in for scored manifests, spectra, envelopes and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.functions.columns import clamp


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored recordings: row_id, family, condition, cluster, truth, pred, pred2."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("p_type").alias("family"),
        F.col("p_size").alias("condition"),
        F.col("p_brand").alias("cluster"),
        (1 + 4 * (F.col("l_quantity") - 1) / 49).alias("truth"),
        clamp(F.col("l_extendedprice") / 26250 + 1, 1, 5).alias("pred"),
        clamp(1 + 4 * (F.col("l_discount") * 5 + F.col("l_tax") * 6.25), 1, 5).alias("pred2"),
    )


MANIFEST = """m as (
  select l_orderkey * 10 + l_linenumber as row_id, p_type as family, p_size as condition, p_brand as cluster,
    1 + 4 * (l_quantity - 1) / 49 as truth, least(5e0, greatest(1e0, l_extendedprice / 26250 + 1)) as pred,
    least(5e0, greatest(1e0, 1 + 4 * (l_discount * 5 + l_tax * 6.25e0))) as pred2
  from lineitem join part on l_partkey = p_partkey)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of band vectors: id, a (a vector's magnitudes), b (those of the next vector of its label)."""
    v = read(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    v = v.select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 1e-3).alias("a"))
    nearest = W.partitionBy("label").orderBy("vec_id")
    return v.withColumn("b", F.lead("a").over(nearest)).where("b is not null").select(F.col("vec_id").alias("id"), "label", "a", "b")


SPECTRA = """v as (
  select vec_id as id, label, list_transform(embedding, lambda x: abs(cast(x as double)) + 1e-3) as a
  from embeddings where embedding is not null and label is not null),
p as (select * from (select id, label, a, lead(a) over (partition by label order by id) as b from v) where b is not null)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly envelopes: user_id, i (hour), x."""
    hour = F.floor(F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))) / 3600) - 473352
    return read(spark, sf_dir, "events").groupBy("user_id", hour.cast("long").alias("i")).agg(F.sum("value").alias("x"))


SERIES = """s as (
  select user_id, cast(floor(epoch(date_trunc('hour', ts)) / 3600) - 473352 as bigint) as i, sum(value) as x
  from events group by all)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ssrc, seq, arrival, event_id, value: an arrival a row. A stream's numbers follow its events' times; each seventh
    packet arrives again, each eleventh 70 seconds late, and each thirteenth is lost."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e = e.withColumn("seq", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    late = F.when(F.col("event_id") % 11 == 0, 70).otherwise(F.col("event_id") % 5)
    micros = F.unix_micros(start) + (F.col("seq") * 20 + late) * F.lit(1_000_000)
    sent = e.select(F.col("user_id").alias("ssrc"), "seq", "event_id", "value", F.timestamp_micros(micros.cast("long")).alias("arrival")).where("event_id % 13 != 0")
    again = sent.where("event_id % 7 = 0").withColumn("arrival", F.col("arrival") + F.expr("interval 1 second"))
    return sent.unionByName(again)


PACKETS = """e as (
  select event_id, user_id, ts, value, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events),
k as (
  select user_id as ssrc, seq, event_id, value,
    cast(seq * 20 + case when event_id % 11 = 0 then 70 else event_id % 5 end as bigint) as arrived
  from e where event_id % 13 <> 0),
a as (select * from k union all select ssrc, seq, event_id, value, arrived + 1 from k where event_id % 7 = 0)"""
