"""Connected components of a link table, by joins and partial minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) of every node of ``links`` (a, b: long), itself included.

    Each round takes the least label of a node's neighbours, then the label of
    that label, so chains shorten by half and more; rounds are written to the
    shared folder. A node with very many links is a hot key of plain joins and
    of a minimum with partial sums, both of which Spark splits.
    """
    both = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = step.join(up, "label").select("node", "old", F.least("label", "top").alias("label"))
        before, step = labels, written(step, "labels")
        dropped(before)
        labels = step.select("node", "label")
        if step.where("old <> label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"links didn't settle in {MAX_ROUNDS} rounds")
