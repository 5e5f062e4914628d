"""Sliding windows over a stream of edges, with the edges that leave them.

A window is the last ``width`` steps of the clock (positions, or times). Of each
vertex, Spark's windowed aggregation holds in its state store how many edges
came in the last step of each live window and in the step before its first; when
the clock has passed a window's end, the first is what arrived there and the
second what it takes out of the window again, and both are forgotten. A vertex
whose edges have all left has no state. What the stream writes are changes
(vertex, position, arrived, departed); ``degrees`` and ``turnover`` add them up.

Counts are taken in part before they are dealt out by vertex, so a hub is a row
a task and window. An edge that its source delivers again
within the window is told by its id and counts once; a batch that is run again
after a failure starts from the state before it. Rows that are more than
``late`` older than the newest of the batches before are left out: that is the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGES = "eid long, src long, dst long, clock long"
CHANGES = "v long, position long, arrived long, departed long"
#: The vertex of rows that only move the clock on.
TICK = -1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes(edges: DataFrame, step: int, width: int, late: int = 0) -> DataFrame:
    """Changes of a stream of edges (eid, src, dst, clock from 0 on): the clock counts milliseconds, as far as Spark is concerned."""
    # Spark takes a row for late that isn't after the watermark, which begins at 0: one more lets ties with it in.
    e = edges.withColumn("at", F.timestamp_millis(F.col("clock") + 1)).withWatermark("at", f"{late + 1} milliseconds")
    e = e.dropDuplicatesWithinWatermark(["eid"])
    ends = e.where(F.col("src") != TICK).select(F.explode(F.array("src", "dst")).alias("v"), F.expr(f"clock div {step}").alias("s"), "at")
    # A row falls into the windows that it is in and into the one that it has just left: width + 1 steps, the last of them the position.
    w = F.window("at", f"{(width + 1) * step} milliseconds", f"{step} milliseconds", "1 milliseconds").alias("w")
    position = F.expr(f"(unix_millis(w.end) - 1) div {step} - 1")
    ends = ends.select("v", "s", w).withColumn("position", position).where((F.col("s") == F.col("position")) | (F.col("s") == F.col("position") - width))
    n = ends.groupBy("w", "v").agg(F.count_if(F.col("s") == F.col("position")).alias("arrived"), F.count_if(F.col("s") < F.col("position")).alias("departed"))
    return n.select("v", position.alias("position"), "arrived", "departed")


def follow(spark: SparkSession, source: str, out: str, checkpoint: str, step: int, width: int, late: int = 0, files: int = 1) -> None:
    """Read the Parquet files of ``source`` that are there, ``files`` a batch, and append the changes to the Parquet table ``out``."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        edges = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", files).parquet(source)
        q = changes(edges, step, width, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)


def tick(spark: SparkSession, clock: int) -> DataFrame:
    """A row that moves the clock of a stream on, so that all before it is reported."""
    return spark.createDataFrame([(TICK, TICK, TICK, clock)], EDGES)


def degrees(changed: DataFrame, positions: int) -> DataFrame:
    """v, position, degree, arrived, departed: of each vertex, the positions where its window changes."""
    d = changed.where((F.col("v") != TICK) & (F.col("position") < positions)).groupBy("v", "position").agg(F.sum("arrived").alias("arrived"), F.sum("departed").alias("departed"))
    w = Window.partitionBy("v").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # at most a row a position
    return d.select("v", "position", F.sum(F.col("arrived") - F.col("departed")).over(w).alias("degree"), "arrived", "departed")


def turnover(changed: DataFrame, positions: int) -> DataFrame:
    """position, active, entered, left, arrived, departed, ends: of each window, its vertices, those that are new to it or gone from it, and its edges' ends."""
    d = degrees(changed, positions)
    w = Window.partitionBy("v").orderBy("position")
    d = d.withColumns({"was": F.coalesce(F.lag("degree").over(w), F.lit(0))})
    d = d.groupBy("position").agg(
        F.count_if((F.col("was") == 0) & (F.col("degree") > 0)).alias("entered"), F.count_if((F.col("was") > 0) & (F.col("degree") == 0)).alias("left"),
        F.sum("arrived").alias("arrived"), F.sum("departed").alias("departed"),
    )
    grid = d.sparkSession.range(positions).withColumnRenamed("id", "position")
    d = grid.join(d, "position", "left").na.fill(0)
    run = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # one row a position
    return d.select("position", F.sum(F.col("entered") - F.col("left")).over(run).alias("active"), "entered", "left", "arrived", "departed", F.sum(F.col("arrived") - F.col("departed")).over(run).alias("ends"))


def windowed(edges: DataFrame, step: int, width: int, positions: int) -> DataFrame:
    """The rows of ``turnover`` from a stored table of edges: what the stream is held against."""
    e = edges.select(F.explode(F.array("src", "dst")).alias("v"), F.expr(f"clock div {step}").alias("s"))
    come = e.groupBy("v", "s").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    both = come.select("v", F.col("s").alias("position"), F.col("n").alias("arrived"), zero.alias("departed")).unionAll(come.select("v", (F.col("s") + width).alias("position"), zero.alias("arrived"), F.col("n").alias("departed")))
    return turnover(both, positions)
