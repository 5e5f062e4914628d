"""Closed-form prices of a placement over a small relation of devices.

Devices are one row each (id, name, mem_bytes, usable_mem, throughput, node,
h2d_gbps, hbm_bw_gbps); their number is that of machines, not of data, so they
are broadcast. All prices are column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GB = 1024**3
RESERVED = 2 * GB
#: Bytes of an edge traversal, gathers per layer, of a feature and of a resident edge; the relief constant.
TRAVERSAL, GATHERS, FEATURE, RESIDENT_EDGE, RELIEF = 4.0, 2.0, 4.0, 20.0, 5.0
#: Fixed values: (name, GB, throughput, node, h2d GB/s, hbm GB/s) of three clusters.
CLUSTERS = {
    "het3": [("large", 79.2, 2.13, 0, 57.5, 942.0), ("middle", 47.4, 1.47, 1, 26.7, 534.0), ("small", 31.5, 1.00, 2, 26.6, 444.0)],
    "het4": [("large", 80.0, 2.13, 0, 57.5, 942.0), ("middle", 48.0, 1.47, 1, 26.7, 560.0), ("middle", 48.0, 1.47, 1, 26.7, 560.0), ("small", 32.0, 1.00, 2, 26.6, 430.0)],
    "hom4": [("large", 80.0, 2.13, 0, 57.5, 942.0)] * 4,
}
DEVICE = "id long, name string, mem_bytes long, usable_mem long, throughput double, node long, h2d_gbps double, hbm_bw_gbps double"


def cluster_rows(name: str) -> list[tuple]:
    return [(i, n, int(gb * GB), int(gb * GB) - RESERVED, r, node, h2d, bw) for i, (n, gb, r, node, h2d, bw) in enumerate(CLUSTERS[name])]


def devices(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(cluster_rows(name), DEVICE)


def devices_sql(name: str) -> str:
    rows = ", ".join(f"({i}::BIGINT, '{n}', {m}, {u}, {r}::DOUBLE, {k}::BIGINT, {h}::DOUBLE, {b}::DOUBLE)" for i, n, m, u, r, k, h, b in cluster_rows(name))
    return f"devices(id, name, mem_bytes, usable_mem, throughput, node, h2d_gbps, hbm_bw_gbps) AS (VALUES {rows})"


def compute_ms(work: Column, bw: Column) -> Column:
    """Roofline time of gathering ``work`` feature elements over a device's memory."""
    return work * TRAVERSAL * GATHERS / (bw * 1e9) * 1e3


def ship_ms(elements: Column, link: float) -> Column:
    return elements * FEATURE * GATHERS / (max(link, 1e-9) * 1e9) * 1e3


def predict_ms(per_part: DataFrame, dev: DataFrame, link: float, inc: str = "inc_fw", comm: str = "comm_fw") -> DataFrame:
    """device, comp_ms, comm_ms, total_ms of feature-weighted work per part."""
    d = per_part.join(F.broadcast(dev.select(F.col("id").alias("part"), "hbm_bw_gbps")), "part")
    comp, ship = compute_ms(F.col(inc), F.col("hbm_bw_gbps")), ship_ms(F.col(comm), link)
    return d.select(F.col("part").alias("device"), F.round(comp, 9).alias("comp_ms"), F.round(ship, 9).alias("comm_ms"), F.round(comp + ship, 9).alias("total_ms"))


def feasible(feature_bytes: Column, incident: Column, usable: Column) -> Column:
    return feature_bytes + incident * RESIDENT_EDGE <= usable


def preflight(parts: DataFrame, dev: DataFrame, feat_dim: int, window: int = 1, sec_per_edge: float = 5e-9) -> DataFrame:
    """device, footprint, headroom, oom, compute_sec, straggler of parts (part, nodes, edges, halo)."""
    d = parts.join(F.broadcast(dev.withColumnRenamed("id", "part")), "part")
    foot = (window * ((F.col("nodes") + F.col("halo")) * feat_dim * 4 + F.col("edges") * 20)).cast("long")
    d = d.select(F.col("part").alias("device"), foot.alias("footprint"), (F.col("usable_mem") - foot).alias("headroom"), (window * F.col("edges") * sec_per_edge / F.col("throughput")).alias("sec"))
    slow = d.agg(F.max("sec").alias("most"))
    return d.join(F.broadcast(slow)).select("device", "footprint", "headroom", (F.col("headroom") < 0).alias("oom"), F.round("sec", 12).alias("compute_sec"), (F.col("sec") == F.col("most")).alias("straggler"))


def calibrate(dev: DataFrame, persistence: DataFrame, link: float, feat_dim: int = 128, window: int = 1, layers: int = 2, hops: int = 2) -> DataFrame:
    """sec_per_edge, w_s, w_t from the slowest memory and the link; a lasting graph recomputes what it doesn't reuse if that is cheaper."""
    per = feat_dim * layers * FEATURE / (F.min("hbm_bw_gbps") * 1e9)
    c = dev.agg(per.alias("sec_per_edge")).join(F.broadcast(persistence.select((F.col("numerator") / F.col("denominator")).alias("rho"))))
    ship = FEATURE * feat_dim * window / (link * 1e9)
    again = F.col("sec_per_edge") * layers * (1 - F.col("rho"))
    w_t = F.when(F.col("rho") > 0, F.least(F.lit(ship), again)).otherwise(ship)
    return c.select(F.round(F.col("sec_per_edge") * 1e9, 9).alias("ns_per_edge"), F.lit(round(FEATURE * feat_dim * hops / (link * 1e9) * 1e9, 9)).alias("w_s_ns"), F.round(w_t * 1e9, 9).alias("w_t_ns"))


def axis_costs(n: int, e: int, feat: float, parts: int, hbm: float, link: float, layers: int = 2) -> dict[str, float]:
    """ms of splitting by vertices, by feature columns, and by the best grid of both; ms of joining whole layers."""
    b, k = hbm * 1e9, link * 1e9
    node = layers * 2 * (e / parts) * feat * TRAVERSAL / b * 1e3 + layers * n * (parts - 1) / parts * feat * FEATURE / k * 1e3
    join = layers * n * feat * FEATURE / k * 1e3
    feature = layers * 2 * e * (feat / parts) * TRAVERSAL / b * 1e3 + join
    grids = [math.inf]
    for dn in range(2, parts):
        if parts % dn == 0:
            cols = feat * dn / parts
            grids.append(layers * (2 * e / dn) * cols * TRAVERSAL / b * 1e3 + layers * (n / dn * (dn - 1) / dn + n / dn) * cols * FEATURE / k * 1e3)
    return {"node": node, "feature": feature, "hybrid": min(grids), "integration": 2 * join, "threshold": RELIEF * (e / max(1, n)) * (parts - 1) / parts}


def decide_axis(g_n: int, g_e: int, dev: list[tuple], feat: float, link: float, layers: int = 2) -> dict:
    """The cheapest axis whose devices hold it; the cheapest of all if none does."""
    c = axis_costs(g_n, g_e, feat, len(dev), min(d[7] for d in dev), link, layers)
    least = min(d[3] for d in dev)
    fits = {"node": g_n / len(dev) * feat * 4 + g_e / len(dev) * RESIDENT_EDGE <= least, "feature": feat / len(dev) * g_n * 4 + g_e * RESIDENT_EDGE <= least, "hybrid": math.isfinite(c["hybrid"])}
    pool = [a for a in ("node", "feature", "hybrid") if fits[a]] or ["node", "feature"]
    return c | {"axis": min(pool, key=c.__getitem__), "relief": feat > c["threshold"]}


def columns_by_weight(dev: DataFrame, columns: int, weight: str) -> DataFrame:
    """id, cols: floor of each device's share of the columns, the remainder to the heaviest devices in turn."""
    total = dev.agg(F.sum(weight).alias("w"), F.count("*").alias("d"))
    c = dev.join(F.broadcast(total)).withColumn("base", F.floor(F.col(weight) / F.col("w") * columns)).withColumn("i", F.row_number().over(Window.orderBy(F.desc(weight), "id")) - 1)
    rest = columns - F.sum("base").over(Window.partitionBy())
    # Device i of the order gets one more for each time the remainder comes round to it.
    more = F.greatest(F.lit(0), F.ceil((rest - F.col("i")) / F.col("d")))
    return c.select("id", (F.col("base") + more).cast("long").alias("cols"))


def feature_plan(n: int, e: int, dev: DataFrame, columns: int, link: float) -> DataFrame:
    """id, cols, compute_ms, integ_ms, resident, fits: a split by memory speed if all devices hold it, else by memory."""

    def priced(weight: str) -> DataFrame:
        d = columns_by_weight(dev, columns, weight).join(F.broadcast(dev.select("id", "hbm_bw_gbps", "usable_mem")), "id")
        resident = F.col("cols") * n * 4 + e * 20
        return d.select("id", "cols", F.round(2 * e * TRAVERSAL * GATHERS * F.col("cols") / (F.col("hbm_bw_gbps") * 1e9) * 1e3, 9).alias("compute_ms"), F.round(n * F.col("cols") * FEATURE * GATHERS / (link * 1e9) * 1e3, 9).alias("integ_ms"), resident.alias("resident"), (resident <= F.col("usable_mem")).alias("fits"))

    fast = priced("hbm_bw_gbps")
    return fast if fast.where("NOT fits").limit(1).count() == 0 else priced("usable_mem")


def grid_plans(n: int, e: int, dev: DataFrame, columns: int, link: float) -> DataFrame:
    """dn, df, makespan_ms, fits of each grid of vertex groups by column groups."""
    spark, d = dev.sparkSession, dev.count()
    grids = spark.createDataFrame([(k, d // k) for k in range(2, d) if d % k == 0], "dn long, df long")
    cols, rows = F.greatest(F.lit(1), F.expr(f"{columns} div df")), F.greatest(F.lit(1), F.expr(f"{n} div dn"))
    comp = 2.0 * e / F.col("dn") * TRAVERSAL * GATHERS * cols / (F.col("hbm_bw_gbps") * 1e9) * 1e3
    ship = rows * cols * FEATURE * GATHERS / (link * 1e9) * 1e3
    fits = rows * cols * 4.0 + e / F.col("dn") * RESIDENT_EDGE <= F.col("usable_mem")
    return grids.join(F.broadcast(dev)).groupBy("dn", "df").agg(F.round(F.max(comp + ship), 9).alias("makespan_ms"), F.min(fits).alias("fits"))


def k_ladder(spark: SparkSession, k_mem: int, k_max: int) -> DataFrame:
    ks, k = set(), k_mem
    while k <= k_max:
        ks.add(k)
        k = max(k + 1, int(k * 1.4))
    return spark.createDataFrame([(x,) for x in sorted(ks | {k_max})], "k long")


def k_curve(spark: SparkSession, work_ms: float, working_set: int, cap: int, overhead: float = 0.05, alpha: float = 0.0545, beta: float = 0.045) -> DataFrame:
    """k, ms, best: the time of k parts along a ladder of factors of 1.4 from the least number that fits."""
    k_mem = max(1, -(-working_set // cap))
    ms = work_ms / F.col("k") + overhead * F.col("k") + alpha * F.log2(F.greatest(F.lit(2), F.col("k"))) + beta
    c = k_ladder(spark, k_mem, k_mem * 64).withColumn("ms", ms)
    least = c.agg(F.min(F.struct("ms", "k")).alias("m"))
    return c.join(F.broadcast(least)).select("k", F.round("ms", 9).alias("ms"), (F.col("k") == F.col("m.k")).alias("best"))


def exposed_ms(comp: Column, comm: Column, overlap: Column) -> Column:
    """Time with communication hidden behind a share of the computation."""
    return comp + F.greatest(F.lit(0.0), comm - overlap * comp)


def recombine_bytes(n: int, columns: int, layers: int, full: bool) -> int:
    return (n * columns + 2 * n * columns * int(full)) * 4 * layers


def coexec_balance(work: float, gpu: float, cpu: float, staged: float, link: float) -> float:
    """f* = (W / Rg) / (W / Rg + W / Rc + S / Rs): the host's share."""
    a = work / gpu
    return a / (a + work / cpu + staged / link)


def migration_sec(rows: Column, width: int, link: float) -> Column:
    return rows * width * 4 / (link * 1e9)
