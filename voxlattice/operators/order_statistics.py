"""Exact order statistics of groups of any size, without an array of a group's values.

Equal values are counted first (with partial sums before the shuffle). The counts are dealt by range of (group, value)
and written, so a large group lies in many partitions, in order; each partition's sum a group gives the offset at which
it begins. Within a partition a running sum tells the places of each value, and the value that holds the wanted place
is the statistic. A task sees one partition, and a group's offsets are as many rows as partitions it lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.session import staged


def order_statistics(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, and for each name of `quantiles` the value at place floor(q (n - 1)) of the group's sorted values, from 0.

    Null values are left out; a group without any has no row; NaN is the largest value; null keys are a group."""
    spark = rows.sparkSession
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_times"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(counts.repartitionByRange(parts, *keys, "_value").withColumn("_part", F.spark_partition_id()), "order-statistics")

    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_times").alias("_own"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"), F.sum("_own").over(W.partitionBy(*keys)).alias("_all"))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_at"), "_before", "_all")

    same = F.col("_part") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = W.partitionBy(*keys, "_part").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    places = dealt.withColumn("_upto", F.sum("_times").over(inside)).join(sums, same)
    upto = F.col("_before") + F.col("_upto")
    place = lambda q: F.floor(F.lit(float(q)) * (F.col("_all") - 1))
    # Of the values that reach beyond a place, the least holds it.
    return places.groupBy(*keys).agg(*[F.min(F.when(upto > place(q), F.col("_value"))).alias(name) for name, q in quantiles.items()])
