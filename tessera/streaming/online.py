"""Placement of a growing graph, window by window, in batch and as a stream.

A window is so many events. The state that decisions need (cursor, staleness,
statistics at the last refresh, placement) is written under the batch's number,
so a replayed batch writes the same rows again and nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..operators import greedy as K
from ..operators import stats as S
from ..sources.graphs import TemporalGraph

DRIFT, STALENESS, BUDGET = 0.15, 1, 0.05
TRACE = "step long, reason string, drift double, moved long, added long, edges long"


def window_row(g: TemporalGraph) -> dict:
    return S.window_stats(g, 1, clustered=True).first().asDict()


def shift(before: dict | None, now: dict) -> float:
    """The drift of two rows of window statistics; 1 without an earlier one."""
    if before is None:
        return 1.0
    out = 0.0
    for name, weight in (("clusterability", 0.35), ("persistence", 0.30), ("avg_degree", 0.20), ("max_snapshot_nodes", 0.15)):
        a, b = float(before[name]), float(now[name])
        out += weight * min(1.0, abs(b - a) / max(abs(a), abs(b), 1e-9))
    return round(min(1.0, out), 6)


def step(g: TemporalGraph, since: int, parts: int, state: dict | None, drift_limit: float = DRIFT, max_stale: int = STALENESS, budget: float = BUDGET) -> dict:
    """The next state: a cold start places all, drift or staleness places what changed, else the placement stays."""
    now = window_row(g)
    if state is None:
        place = kept(K.online(g, parts), "placement")
        return {"reason": "cold", "drift": 0.0, "place": place, "stats": now, "stale": 0, "moved": 0, "added": place.count()}
    drift = shift(state["stats"], now)
    if drift > drift_limit or state["stale"] + 1 > max_stale:
        prior = state["place"]
        place = kept(K.matched(prior, K.incremental(g, prior, since, parts, budget), parts), "placement")
        m = K.migration(prior, place, 1).first()
        return {"reason": "drift" if drift > drift_limit else "stale", "drift": drift, "place": place, "stats": now, "stale": 0, "moved": m["moved"], "added": m["added"]}
    return state | {"reason": "reuse", "drift": drift, "stale": state["stale"] + 1, "moved": 0, "added": 0}


def run_stream(g: TemporalGraph, windows: int, parts: int, sliding: bool = False, **options) -> DataFrame:
    """The trace over count windows of a stored graph; the last, partial window stays."""
    size = -(-g.num_edges // windows)
    state, rows = None, []
    for k in range(windows):
        lo, hi = k * size, min((k + 1) * size, g.num_edges)
        if lo >= hi:
            break
        e = g.edges.where((F.col("pos") >= (lo if sliding else 0)) & (F.col("pos") < hi))
        view = TemporalGraph(e, g.num_nodes, hi - (lo if sliding else 0), f"{g.name}-{k}")
        state = step(view, lo, parts, state, **options)
        rows.append((k, state["reason"], state["drift"], state["moved"], state["added"], hi - lo))
    return g.spark.createDataFrame(rows, TRACE)


def stream_files(spark: SparkSession, source: str, out: str, num_nodes: int, parts: int, checkpoint: str, **options) -> None:
    """Place the edges (eid, src, dst, t) of Parquet files as they come, one file a batch; the trace and placements go under ``out``.

    A batch reads what the one before it wrote, keyed by its number, and numbers
    its own edges on from there: edges have their places in the order in which
    they came, and by time within a batch. A batch that is run again writes the same.
    """
    schema = "eid long, src long, dst long, t long"

    def read(path: str, kind: str | None = None) -> DataFrame | None:
        try:
            d = spark.read.schema(kind).parquet(path) if kind else spark.read.parquet(path)
            d.limit(1).count()
            return d
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def batch(df: DataFrame, k: int) -> None:
        before = read(f"{out}/state/batch={k - 1}") if k else None
        last = before.first().asDict() if before is not None else None
        since = last["edges"] if last else 0
        # Only what has come is put in order and numbered, after all that came before.
        with_position(df, ["t", "eid"]).withColumn("pos", F.col("pos") + since).write.mode("overwrite").parquet(f"{out}/edges/batch={k}")
        came = spark.read.parquet(f"{out}/edges/batch={k}").count()
        seen = spark.read.parquet(f"{out}/edges").where(F.col("batch") <= k).select("pos", "src", "dst", "t")
        g = TemporalGraph(seen, num_nodes, since + came, "stream")
        state = None
        if last is not None:
            state = {"stats": {n: last[n] for n in ("persistence", "avg_degree", "max_snapshot_nodes", "clusterability")}, "stale": last["stale"], "place": spark.read.parquet(f"{out}/place/batch={k - 1}")}
        new = step(g, since, parts, state, **options)
        new["place"].write.mode("overwrite").parquet(f"{out}/place/batch={k}")
        stats = new["stats"]
        row = [(float(stats["persistence"]), float(stats["avg_degree"]), int(stats["max_snapshot_nodes"]), float(stats["clusterability"]), new["stale"], new["reason"], new["drift"], new["moved"], new["added"], since + came)]
        spark.createDataFrame(row, "persistence double, avg_degree double, max_snapshot_nodes long, clusterability double, stale long, reason string, drift double, moved long, added long, edges long").write.mode("overwrite").parquet(f"{out}/state/batch={k}")

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def blockwise(g: TemporalGraph, blocks: int, parts: int) -> DataFrame:
    """v, part: each block of events places the vertices that it is the first to show; those that never come are on part 0."""
    done = None
    for k in range(blocks):
        e = g.edges.where(F.expr(f"pos * {blocks} div {max(1, g.num_edges)}") == k)
        view = TemporalGraph(e, g.num_nodes, max(1, g.num_edges // blocks))
        place = K.online(view, parts, batches=4)
        active = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        new = place.join(active, "v", "left_semi")
        if done is not None:
            new = new.join(done, "v", "left_anti")
        done = kept(new if done is None else done.unionAll(new), "blocks")
    rest = g.vertices().select("v").join(done, "v", "left_anti").select("v", F.lit(0).cast("long").alias("part"))
    return done.unionAll(rest)


