"""Queries on visit orders, spectra and refinements of a placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import dropped, kept
from ..operators import halo as H
from ..operators import placement as P
from ..operators import spectra as E
from ..operators import walks as W
from ..sources import graphs
from .growth_queries import registrar
from .structure_queries import _HASH, D

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)

# A sequential walk: one row holds the queue and the place in it.
_WALK = graphs.sql_prefix("F", 8).replace("WITH n AS", "WITH RECURSIVE n AS", 1) + """, pairs AS (SELECT DISTINCT a, b FROM sym WHERE a <> b), adj AS (SELECT a, list(b ORDER BY b) AS near FROM pairs GROUP BY a),
root AS (SELECT a AS r FROM pairs GROUP BY a ORDER BY count(*) DESC, a LIMIT 1), ring AS (SELECT list(v ORDER BY (v - r + n) % n) AS ring FROM verts, root, n),
q AS (SELECT [r] AS queue, [NULL::BIGINT] AS par, 0::BIGINT AS i FROM root UNION ALL
      SELECT list_concat(queue, found), list_concat(par, list_transform(found, lambda x: top)), i2 FROM (
        SELECT queue, par, CASE WHEN i < len(queue) THEN i + 1 ELSE i END AS i2, CASE WHEN i < len(queue) THEN queue[i + 1] END AS top,
               CASE WHEN i < len(queue) THEN list_filter(coalesce(near, []::BIGINT[]), lambda x: NOT list_contains(queue, x)) ELSE [list_filter(ring, lambda x: NOT list_contains(queue, x))[1]] END AS found
        FROM q CROSS JOIN ring LEFT JOIN adj ON adj.a = queue[i + 1] WHERE i < len(queue) OR len(queue) < len(ring))),
whole AS (SELECT queue, par FROM q ORDER BY len(queue) DESC, i DESC LIMIT 1), walk AS (SELECT unnest(queue) AS v, unnest(par) AS parent, unnest(range(len(queue))) AS rank FROM whole)"""  # fmt: skip
_TREE = """, kids AS (SELECT parent, list(v ORDER BY rank) AS kids FROM walk WHERE parent IS NOT NULL GROUP BY 1),
st AS (SELECT (SELECT list(v ORDER BY rank) FROM walk WHERE parent IS NULL) AS stack, []::BIGINT[] AS done UNION ALL
       SELECT list_concat(coalesce(kids, []::BIGINT[]), stack[2:]), list_append(done, stack[1]) FROM st LEFT JOIN kids ON parent = stack[1] WHERE len(stack) > 0),
pre AS (SELECT done FROM st ORDER BY len(done) DESC LIMIT 1)"""

query("queue_order", "F")(lambda g, s: W.queue_order(g).select("v", "parent", "rank"))
ORACLE_SQL["queue_order"] = _WALK + " SELECT v, parent, rank FROM walk"
query("tree_preorder", "F")(lambda g, s: W.preorder(kept(W.queue_order(g), "walk")))
ORACLE_SQL["tree_preorder"] = _WALK + _TREE + " SELECT unnest(done) AS v, unnest(range(len(done))) AS rank FROM pre"


@query("fiedler_cut", "F")
def _fiedler(g, s):
    """lambda2, the sweep's cut, volume and conductance, and the vertices of the lesser side."""
    lam, side, row = E.fiedler(g)
    n = side.agg(F.count_if("side").alias("x"), F.count_if(~F.col("side")).alias("y")).select(F.least("x", "y").alias("vertices"))
    return row.join(F.broadcast(n)).select(F.lit(round(lam, 3)).alias("lambda2"), "cut", "vol", F.round("conductance", 3).alias("conductance"), "vertices")


query("snapshot_lambda2", "F")(lambda g, s: E.snapshot_gaps(g, s))
query("space_time_bound", "F")(lambda g, s: E.lower_bound(g, s, 4))


# Halo rows and edge ends of the placement that refinement begins from; loops don't count.
_START = _HASH + """, hs AS (SELECT DISTINCT x.part, b FROM sym JOIN pl x ON x.v = a JOIN pl y ON y.v = b WHERE a <> b AND x.part <> y.part),
wk AS (SELECT part, count(*) AS ends FROM sym JOIN pl ON v = a WHERE a <> b GROUP BY part), hc AS (SELECT part, count(*) AS halo FROM hs GROUP BY part)"""


def _refined(objective: str):
    def run(g, s):
        """The objective before (a value), and whether it falls, is what it is said to be, and vertices and caps are kept."""
        start = kept(P.by_hash(g, D).select("v", "part"), "start")
        cap = 1.05 * g.num_nodes / D
        done, trace = H.refined(g, start, D, cap, objective)
        inc = kept(H.incidence(H.both(H.simple(g)), done), "incidence")
        costs = H.part_costs(inc, done)
        now = sum(c[2] for c in costs.values()) if objective == "halo" else max(c[1] + H.ALPHA * c[2] for c in costs.values())
        row = (trace[0], all(a > b for a, b in zip(trace, trace[1:], strict=False)) and now <= trace[0], now == trace[-1], sum(c[0] for c in costs.values()) == g.num_nodes, max(c[0] for c in costs.values()) <= cap)
        dropped(start, inc, done)
        return g.spark.createDataFrame([row], "before long, falls boolean, recounted boolean, covered boolean, within_cap boolean")

    return run


_KEPT = "true AS falls, true AS recounted, true AS covered, true AS within_cap"
query("halo_polish", "O", _START + f" SELECT (SELECT count(*) FROM hs)::BIGINT AS before, {_KEPT}")(_refined("halo"))
query("straggler_polish", "O", _START + f" SELECT (SELECT max(ends + {H.ALPHA} * coalesce(halo, 0)) FROM wk LEFT JOIN hc USING (part))::BIGINT AS before, {_KEPT}")(_refined("straggler"))
