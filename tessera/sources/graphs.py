"""Temporal graphs as DataFrames, and the three that the driver's tables hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.position import with_position
from ..functions.scratch import instead


@dataclass(frozen=True)
class TemporalGraph:
    """Edges (pos, src, dst, t and more) in time order, and the vertex domain 0..num_nodes - 1."""

    edges: DataFrame
    num_nodes: int
    num_edges: int
    name: str = ""
    #: v, fv of vertices whose feature rows have widths of their own.
    widths: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def vertices(self) -> DataFrame:
        """v and fv, the width of its feature row: a fixed mix of wide and narrow ones."""
        v = F.col("v")
        ids = self.spark.range(self.num_nodes).select(F.col("id").alias("v"))
        if self.widths is not None:
            return ids.join(self.widths.select("v", "fv"), "v", "left").select("v", F.coalesce(F.col("fv").cast("long"), F.lit(128)).alias("fv"))
        wide = F.when(v % 20 == 0, 16).when((v % 20).between(1, 3), 4).otherwise(1)
        return ids.withColumn("fv", (wide * 128).cast("long"))

    def with_widths(self, table: DataFrame) -> TemporalGraph:
        """The graph with the feature widths of ``table`` (v, fv); 128 where it has none."""
        return replace(self, widths=table)


def from_edges(edges: DataFrame, order: list[str], num_nodes: int | None = None, name: str = "", weights: tuple[str, ...] = ()) -> TemporalGraph:
    """Sort by time (``order`` breaks ties), number the edges, keep the table."""
    e = instead(with_position(edges, order).select("pos", "src", "dst", "t", *weights), name or "edges")
    row = e.agg(F.count("*").alias("e"), F.max(F.greatest("src", "dst")).alias("m")).first()
    return TemporalGraph(e, num_nodes if num_nodes is not None else (row["m"] or -1) + 1 if row["e"] else 0, row["e"], name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("long")


def event_graph(spark: SparkSession, sf_dir: str) -> TemporalGraph:
    """Users to items, one edge an event; weight -1 for errors."""
    ev = _read(spark, sf_dir, "events")
    users = ev.agg(F.max("user_id")).first()[0] + 1
    e = ev.select(
        F.col("event_id").alias("eid"), F.col("user_id").alias("src"), (F.lit(users) + _item()).alias("dst"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.when(F.col("event_type") == "error", -1.0).otherwise(1.0).alias("w"), "value",
    )
    return from_edges(e, ["t", "eid"], users + 100, "event", ("w", "value"))


def order_graph(spark: SparkSession, sf_dir: str) -> TemporalGraph:
    """Customers to parts, one edge a line item, at the order's date: many ties in time."""
    li, od = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    c, p = _read(spark, sf_dir, "customer").count(), _read(spark, sf_dir, "part").count()
    rest = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    e = li.join(od.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("src"), (F.lit(c) + F.col("l_partkey")).alias("dst"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), *rest
    )
    return from_edges(e, ["t", *rest], c + p, "order", ("l_quantity", "l_extendedprice"))


def flow_graph(spark: SparkSession, sf_dir: str) -> TemporalGraph:
    """Item to next item of the same user."""
    ev = _read(spark, sf_dir, "events").withColumn("k", _item())
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = ev.select(F.col("event_id").alias("eid"), F.lag("k").over(w).alias("src"), F.col("k").alias("dst"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).where("src IS NOT NULL")
    return from_edges(e, ["t", "eid"], 100, "flow")


GRAPHS: dict[str, Callable[[SparkSession, str], TemporalGraph]] = {"E": event_graph, "O": order_graph, "F": flow_graph}
_OPEN: dict[tuple[str, str, str], TemporalGraph] = {}


def graph(spark: SparkSession, sf_dir: str, name: str) -> TemporalGraph:
    """One of GRAPHS; its numbered edge table is written once an application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _OPEN:
        _OPEN[key] = GRAPHS[name](spark, sf_dir)
    return _OPEN[key]


_ITEM = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_SQL = {
    "E": f"""n AS (SELECT max(user_id) + 101 AS n FROM events),
edges AS (SELECT row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS pos, user_id AS src,
                 (SELECT max(user_id) + 1 FROM events) + {_ITEM} AS dst, epoch_us(ts) AS t FROM events)""",
    "O": """n AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS n),
edges AS (SELECT row_number() OVER (ORDER BY epoch_us(o_orderdate), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                                    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS pos,
                 o_custkey AS src, (SELECT count(*) FROM customer) + l_partkey AS dst, epoch_us(o_orderdate) AS t
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "F": f"""n AS (SELECT 100 AS n),
steps AS (SELECT event_id, lag({_ITEM}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, {_ITEM} AS dst, epoch_us(ts) AS t FROM events),
edges AS (SELECT row_number() OVER (ORDER BY t, event_id) - 1 AS pos, src, dst, t FROM steps WHERE src IS NOT NULL)""",
}


def sql_prefix(name: str, snaps: int = 8) -> str:
    """WITH clause of a graph: n, edges, m (their number), es (with snap), sym (both ways), verts, cells, deg."""
    return f"""WITH {_SQL[name]},
m AS (SELECT count(*)::BIGINT AS m FROM edges),
es AS (SELECT pos, src, dst, t, least(pos * {snaps} // (SELECT m FROM m), {snaps - 1}) AS snap FROM edges),
sym AS (SELECT pos, src AS a, dst AS b, snap FROM es UNION ALL SELECT pos, dst, src, snap FROM es),
verts AS (SELECT v, 128 * CASE WHEN v % 20 = 0 THEN 16 WHEN v % 20 BETWEEN 1 AND 3 THEN 4 ELSE 1 END AS fv
          FROM (SELECT unnest(range(0, (SELECT n FROM n)::BIGINT)) AS v)),
cells AS (SELECT row_number() OVER (ORDER BY a, snap) - 1 AS cell_id, a AS v, snap FROM (SELECT DISTINCT a, snap FROM sym)),
deg AS (SELECT v, count(a)::BIGINT AS deg FROM verts LEFT JOIN sym ON a = v GROUP BY v)
"""
