"""Queries on sliding streams and on sources that tasks read by ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scratch import shared_dir
from ..sources import binary
from ..streaming import departures as W
from .growth_queries import registrar

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)
POSITIONS, WIDTH, BATCHES = 16, 4, 4


def _streamed(g):
    """The changes that a stream of the graph's edges makes, its files coming one by one."""
    step = -(-g.num_edges // POSITIONS)
    at = f"{shared_dir(g.spark)}/tessera-stream-{uuid.uuid4().hex[:12]}"
    e = g.edges.select(F.col("pos").alias("eid"), "src", "dst", F.col("pos").alias("clock"))
    for k in range(BATCHES):
        e.where(F.expr(f"eid * {BATCHES} div {max(1, g.num_edges)}") == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    W.tick(g.spark, (POSITIONS + WIDTH + 1) * step).write.mode("append").parquet(f"{at}/in")
    W.follow(g.spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", step, WIDTH)
    return g.spark.read.schema(W.CHANGES).parquet(f"{at}/out")


_STEP = f""", st AS (SELECT pos // ((m + {POSITIONS - 1}) // {POSITIONS}) AS s, src, dst FROM edges, m),
ev AS (SELECT src AS v, s FROM st UNION ALL SELECT dst, s FROM st), pp AS (SELECT unnest(range({POSITIONS})) AS position),
dg AS (SELECT position, v, count(*) AS degree FROM pp JOIN ev ON s > position - {WIDTH} AND s <= position GROUP BY 1, 2)"""


query("sliding_departures", "E", _STEP + f"""
SELECT p.position, (SELECT count(*) FROM dg d WHERE d.position = p.position)::BIGINT AS active,
(SELECT count(*) FROM dg d ANTI JOIN (SELECT v, position + 1 AS position FROM dg) o USING (v, position) WHERE position = p.position)::BIGINT AS entered,
(SELECT count(*) FROM (SELECT v, position + 1 AS position FROM dg) o ANTI JOIN dg d USING (v, position) WHERE position = p.position)::BIGINT AS "left",
(SELECT count(*) FROM ev WHERE s = p.position)::BIGINT AS arrived, (SELECT count(*) FROM ev WHERE s = p.position - {WIDTH})::BIGINT AS departed,
(SELECT count(*) FROM ev WHERE s > p.position - {WIDTH} AND s <= p.position)::BIGINT AS ends FROM pp p""")(lambda g, s: W.turnover(_streamed(g), POSITIONS))  # fmt: skip
query("sliding_degrees", "F", _STEP + f""", ar AS (SELECT v, s AS position, count(*) AS arrived FROM ev GROUP BY 1, 2),
ch AS (SELECT v, position, coalesce(a.arrived, 0) AS arrived, coalesce(d.arrived, 0) AS departed FROM ar a FULL JOIN (SELECT v, position + {WIDTH} AS position, arrived FROM ar) d USING (v, position) WHERE position < {POSITIONS})
SELECT v, position, sum(arrived - departed) OVER (PARTITION BY v ORDER BY position)::BIGINT AS degree, arrived::BIGINT AS arrived, departed::BIGINT AS departed FROM ch""")(lambda g, s: W.degrees(_streamed(g), POSITIONS))  # fmt: skip


def binary_sums(g):
    """The graph's edges written as raw arrays and read back by ranges of 10,000 edges, and sums over them; that of products is a decimal where 64 bits don't hold one."""
    at = f"{shared_dir(g.spark)}/tessera-arrays-{uuid.uuid4().hex[:12]}"
    binary.write_edge_arrays(g.edges, at)
    e = binary.read_edge_arrays(g.spark, at, 10_000)
    # Products of two ids fit in 64 bits, their sums needn't; eight rows at most come here.
    n = e.groupBy((F.col("src") % 8).alias("bucket")).agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"), F.sum((F.col("src") * F.col("dst")).cast("decimal(20,0)")).alias("products")).collect()
    kind = "long" if all(r["products"] < 1 << 63 for r in n) else "decimal(38,0)"
    rows = [(*r[:4], int(r["products"]) if kind == "long" else r["products"]) for r in n]
    return g.spark.createDataFrame(rows, f"bucket long, edges long, src_sum long, dst_sum long, products {kind}")


query("binary_edges", "O", " SELECT src % 8 AS bucket, count(*)::BIGINT AS edges, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum, sum(src * dst)::BIGINT AS products FROM edges GROUP BY 1")(lambda g, s: binary_sums(g))
