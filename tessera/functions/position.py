"""Global positions without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept

_LOCAL = (1 << 33) - 1


def with_position(df: DataFrame, keys: list[str | Column], name: str = "pos") -> DataFrame:
    """``df`` with 0-based positions in the order of ``keys``; rows that tie get positions in any order.

    Rows are dealt out by ranges and sorted within them; each range's start is
    the sum of the counts before it, a table of one row per partition. The
    dealt rows are written first, because a second run could draw other ranges.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    dealt = kept(dealt, "positions").withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(_LOCAL))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_s"))
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_m", "_p", "_i", "_s")
