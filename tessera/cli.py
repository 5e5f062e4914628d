"""``python -m tessera.cli COMMAND``: info, ingest, cluster, plan, schedule, partition over the graphs of a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import cost, greedy, metrics, placement, stats, temporal
from .plans import arrange
from .sources.graphs import GRAPHS, graph

METHODS = {
    "hash": placement.by_hash,
    "locality": lambda g, d: placement.by_locality(g, d),
    "multilevel": greedy.multilevel,
    "online": greedy.online,
    "fennel": lambda g, d: greedy.streamed(g, d, ("fennel",)),
    "ldg": lambda g, d: greedy.streamed(g, d, ("ldg",)),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["datasets", "info", "ingest", "cluster", "plan", "schedule", "partition"])
    p.add_argument("--tables", default=".", help="folder of the Parquet tables")
    p.add_argument("--graph", default="E", choices=sorted(GRAPHS))
    p.add_argument("--snapshots", type=int, default=8)
    p.add_argument("--cluster", default="het4", choices=sorted(cost.CLUSTERS))
    p.add_argument("--link", type=float, default=50.0, help="GB/s between devices")
    p.add_argument("--parts", type=int, default=4)
    p.add_argument("--method", default="multilevel", choices=sorted(METHODS))
    p.add_argument("--out", help="folder for the placement and its metrics")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "datasets":
        spark.createDataFrame([(k, (f.__doc__ or "").strip()) for k, f in sorted(GRAPHS.items())], "graph string, about string").show(truncate=False)
        return
    if a.command == "cluster":
        cost.devices(spark, a.cluster).show(truncate=False)
        return
    g = graph(spark, a.tables, a.graph)
    if a.command == "info":
        temporal.summary(g).show()
    elif a.command == "ingest":
        stats.graph_stats(g, a.snapshots).show(vertical=True)
    elif a.command == "plan":
        arrange.plan(g, a.snapshots, a.cluster, a.link).show()
    elif a.command == "schedule":
        arrange.schedule(g, a.snapshots, a.cluster, a.link).show(vertical=True)
    else:
        place = METHODS[a.method](g, a.parts).select("v", "part")
        report = metrics.report(g, place, a.parts)
        if a.out:
            place.write.mode("overwrite").parquet(f"{a.out}/placement")
            report.coalesce(1).write.mode("overwrite").json(f"{a.out}/metrics")
        report.show(vertical=True)


if __name__ == "__main__":
    main()
