"""Edge files of the common text forms, as DataFrames; malformed lines are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.position import with_position
from .binary import read_edge_arrays

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _whole(c):
    """A number's whole part, toward zero."""
    return F.col(c).cast("double").cast("long") if isinstance(c, str) else c.cast("double").cast("long")


def parse_edge_list(lines: DataFrame) -> DataFrame:
    """src, dst, t of white-space separated lines; comments (#) and short lines go."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(~F.trim("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 3).select(_whole(F.col("f")[0]).alias("src"), _whole(F.col("f")[1]).alias("dst"), _whole(F.col("f")[2]).alias("t"))


def parse_ratings(lines: DataFrame) -> DataFrame:
    """src, dst, w, t of ``source,target,rating,time`` lines."""
    f = F.split("value", ",")
    return lines.select(f.alias("f")).where(F.size("f") >= 4).select(_whole(F.col("f")[0]).alias("src"), _whole(F.col("f")[1]).alias("dst"), F.col("f")[2].cast("double").alias("w"), _whole(F.col("f")[3]).alias("t"))


def parse_jodie(lines: DataFrame) -> DataFrame:
    """user, item, t, label, efeat of ``user,item,ts,label,f0..`` lines, header or not; users first, items after them in one id space.

    Features are kept only if all lines have equally many: else efeat is null everywhere.
    """
    f = F.split(F.trim("value"), ",")
    rows = lines.select(f.alias("f")).where((F.size("f") >= 4) & F.col("f")[0].rlike(NUMBER))
    rows = rows.select(_whole(F.col("f")[0]).alias("u"), _whole(F.col("f")[1]).alias("i"), _whole(F.col("f")[2]).alias("t"), _whole(F.col("f")[3]).alias("label"), F.slice("f", 5, 1 << 20).cast("array<double>").alias("efeat"))
    even = rows.agg(F.count_distinct(F.size("efeat")).alias("k")).first()["k"] <= 1
    users = with_position(rows.select("u").distinct(), ["u"], "user")
    items = with_position(rows.select("i").distinct(), ["i"], "item")
    n = users.count()
    out = rows.join(users, "u").join(items.withColumn("item", F.col("item") + n), "i")
    return out.select("user", "item", "t", "label", (F.col("efeat") if even else F.lit(None).cast("array<double>")).alias("efeat"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzip."""
    return parse_edge_list(spark.read.text(path))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return parse_ratings(spark.read.text(path))


def read_jodie(spark: SparkSession, path: str) -> DataFrame:
    return parse_jodie(spark.read.text(path))


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, src, dst of little-endian files: int64 N, int64 M, M int32 sources, M int32 destinations; many tasks read one."""
    return read_edge_arrays(spark, path).select("file", "pos", "src", "dst")


def read_npz_edges(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, src, dst, t of NPZ files with arrays src and dst, and t (the position where there is none)."""
    return read_edge_arrays(spark, path)


def write_metis(edges: DataFrame, num_nodes: int, path: str) -> None:
    """A symmetric simple graph in METIS text form: the header, then each vertex's neighbours from 1, in order of vertices."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    m = e.count()
    near = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("v")).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("b")), lambda x: (x + 1).cast("string"))).alias("value"))
    spark = edges.sparkSession
    rows = spark.range(num_nodes).withColumnRenamed("id", "v").join(near, "v", "left").select("v", F.coalesce("value", F.lit("")).alias("value"))
    head = spark.createDataFrame([(-1, f"{num_nodes} {m}")], "v long, value string")
    head.unionAll(rows).orderBy("v").select("value").write.text(path)


class EdgeStore:
    """Append-only edges in Parquet by day of ``t``; a time range reads only its days."""

    DAY = 86_400_000_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def ingest(self, edges: DataFrame) -> None:
        edges.withColumn("day", F.floor(F.col("t") / self.DAY)).write.mode("append").partitionBy("day").parquet(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("day")

    def range(self, t0: int, t1: int) -> DataFrame:
        """Edges with t0 <= t < t1."""
        days = F.col("day").between(t0 // self.DAY, (t1 - 1) // self.DAY)
        return self.spark.read.parquet(self.path).where(days & (F.col("t") >= t0) & (F.col("t") < t1)).drop("day")
