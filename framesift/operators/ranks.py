"""Row numbers over large tables: by ranges of the order, never all rows (or all of one key) in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import checkpointed


def ranked(rows: DataFrame, order: list[str | Column], place: str = "place") -> DataFrame:
    """Add ``place``, from 1, in an order. Rows that the order leaves equal get places beside each other, in any order.

    Rows are dealt out by ranges of the order and written once, so that every
    reader sees the same ranges; places count on from the ranges before."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).repartitionByRange("_o")
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_o"))
    return dealt.join(F.broadcast(before), "_part").withColumn(place, F.col("_before") + within).drop("_o", "_part", "_before", "_n")


def down(c: str | Column) -> Column:
    """A number as it sorts downwards: nulls last."""
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(c.isNull().alias("none"), (-c).alias("v"))


def ranked_within(rows: DataFrame, key: str, order: list[str | Column], place: str = "place") -> DataFrame:
    """Add ``place``, from 1 within each value of ``key``; one key may hold most rows."""
    r = ranked(rows, [key, *order], place)
    first = r.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_first"))
    return r.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(place, F.col(place) - F.col("_first") + 1).drop("_key", "_first")


def carried(rows: DataFrame, key: str, at: str, value: Column, name: str, stretch: int = 1024) -> DataFrame:
    """Add ``name``: the largest value so far along ``at`` (a long) within each key, the row's own included; by stretches of ``at``, so one key may hold most rows."""
    r = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col(at) / stretch))
    tops = r.groupBy(F.col(key).alias("_key"), F.col("_b").alias("_of")).agg(F.max("_v").alias("_top"))
    before = F.max("_top").over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("_key", "_of", before.alias("_top"))
    within = F.max("_v").over(Window.partitionBy(key, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    j = r.join(tops, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_of"))).withColumn(name, within)
    return j.withColumn(name, F.greatest(name, "_top")).drop("_v", "_b", "_key", "_of", "_top")


def counted_within(rows: DataFrame, key: str, order: str, count: str, name: str) -> DataFrame:
    """Add ``name``: how many there are up to each row within its key, by ``order`` (distinct in a key); each row stands for ``count``. By ranges of (key, order), written once."""
    dealt = rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    parts = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).agg(F.sum(count).alias("_n"))
    before = parts.select("_key", "_in", (F.sum("_n").over(Window.partitionBy("_key").orderBy("_in")) - F.col("_n")).alias("_before"))
    within = F.sum(count).over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    j = dealt.withColumn("_within", within).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")))
    return j.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_key", "_in", "_before", "_within")
