"""Exact visit orders: the queue order of a breadth-first walk, and the preorder of its tree.

The queue order goes level by level: a vertex comes after all that have an
earlier first neighbour in the level before, and among those of one neighbour
in the order of ids. That neighbour is its parent in the tree. The tree's
preorder comes from its Euler tour: each vertex but the roots is a step down
and a step up again, every step knows the next one from a vertex's first child,
next sibling and parent, and the steps are ranked by doubling, so a tree as
deep as a chain takes as many rounds as the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from ..sources.graphs import TemporalGraph
from .iterate import breadth_first
from .supra import both_ways


def queue_order(g: TemporalGraph, root: int | None = None) -> DataFrame:
    """v, rank, level, parent (null for a root): all vertices in the order in which a queue gives them out.

    The walk begins at ``root`` or at the vertex of highest degree, and begins again in each other component, at
    its first vertex in the cyclic order of ids after the root; components come in that order.
    """
    sym = kept(both_ways(g.edges).where("a <> b").distinct(), "simple")
    level = kept(breadth_first(g, root, restart=True), "levels")
    start = level.where("level = 0").select("root")
    first = _start(sym, root)
    order = with_position(start.withColumn("turn", F.expr(f"(root - {first} + {max(1, g.num_nodes)}) % {max(1, g.num_nodes)}")), ["turn"], "tree").select("root", "tree")
    level = kept(level.join(order, "root"), "levels")
    # Within a tree: the place in the level before, by the first parent, then by id.
    done = kept(level.where("level = 0").select("v", "tree", "level", F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("parent")), "front")
    front, out, deepest = done, done, level.agg(F.max("level")).first()[0] or 0
    near = kept(sym.join(level.select(F.col("v").alias("a"), F.col("level").alias("la")), "a").join(level.select(F.col("v").alias("b"), F.col("level").alias("lb")), "b").where("lb = la + 1").select("a", "b", "lb"), "down")
    for k in range(1, deepest + 1):
        found = near.where(F.col("lb") == k).join(front.select(F.col("v").alias("a"), "tree", "place"), "a").groupBy(F.col("b").alias("v"), "tree").agg(F.min(F.struct("place", "a")).alias("m"))
        placed = with_position(found.select("v", "tree", F.col("m.place").alias("from"), F.col("m.a").alias("parent")), ["from", "v"], "place")
        front = kept(placed.select("v", "tree", F.lit(k).cast("long").alias("level"), "place", "parent"), "front")
        out = out.unionAll(front)
        if k % 16 == 0:
            out = kept(out, "order")
    return with_position(out, ["tree", "level", "place"], "rank").select("v", "rank", "level", "parent")


def _start(sym: DataFrame, root: int | None) -> int:
    if root is not None:
        return root
    top = sym.groupBy("a").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "a").first()
    return top["a"] if top else 0


def ranked(steps: DataFrame) -> DataFrame:
    """step, behind: of a linked list (step, next, w; next null at the end of a list) the sum of w from each step to its list's end, by doubling."""
    now = kept(steps.select("step", "next", F.col("w").cast("long").alias("behind")), "list")
    while now.where("next IS NOT NULL").limit(1).count():
        far = now.select(F.col("step").alias("next"), F.col("next").alias("after"), F.col("behind").alias("more"))
        now = kept(now.join(far, "next", "left").select("step", F.col("after").alias("next"), (F.col("behind") + F.coalesce("more", F.lit(0))).alias("behind")), "list")
    return now.select("step", "behind")


def preorder(tree: DataFrame) -> DataFrame:
    """v, rank: the preorder of a forest (v, parent, rank), the children of a vertex and the roots in the order of ``rank``.

    A step down to v is 2 v, the step up from it 2 v + 1.
    """
    t = tree.select("v", "parent", "rank")
    sibling = t.where("parent IS NOT NULL").withColumn("sibling", F.lead("v").over(Window.partitionBy("parent").orderBy("rank")))
    child = t.where("parent IS NOT NULL").groupBy(F.col("parent").alias("v")).agg(F.min_by("v", "rank").alias("child"))
    # Roots follow each other as the children of one vertex would: by their places.
    roots = with_position(t.where("parent IS NULL").select("v", "rank"), ["rank"], "i").select("v", "i")
    after = roots.join(roots.select((F.col("i") - 1).alias("i"), F.col("v").alias("sibling")), "i", "left").select("v", "sibling")
    kin = t.join(sibling.select("v", "sibling").unionAll(after), "v", "left").join(child, "v", "left")
    down = kin.select((2 * F.col("v")).alias("step"), F.when(F.col("child").isNotNull(), 2 * F.col("child")).otherwise(2 * F.col("v") + 1).alias("next"), F.lit(1).alias("w"))
    up = kin.select((2 * F.col("v") + 1).alias("step"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"), F.lit(0).alias("w"))
    behind = ranked(down.unionAll(up)).where("step % 2 = 0")
    n = t.count()
    return behind.select(F.expr("step div 2").alias("v"), (F.lit(n) - F.col("behind")).alias("rank"))
