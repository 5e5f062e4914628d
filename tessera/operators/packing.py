"""Makespan packing on counts of equal work: differencing, and a search that moves and swaps copies.

Both see classes, a work and how many items have it, never items: the driver
gets one row a class. Works that are degrees have at most the root of four times
the edges of them, as their sum is twice the edges. Items get their parts by a
join of their places within their class with the spans that the plan gives each
part.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..functions.scratch import kept
from .orders import filled_by_time

Classes = list[tuple[int, int]]


def differenced(classes: Classes, parts: int) -> np.ndarray:
    """Counts [class, part] by largest differencing: the two widest partial packings are joined, the heavy parts of one with the light parts of the other.

    A partial packing stands for all its copies, and half of them are joined with the other half at a time, so the
    steps are about the classes times the logarithm of their counts. A part's content is a sum of two others', which
    the last step counts through from the end.
    """
    kids: list[tuple[int, int] | None] = [None] * (len(classes) + 1)  # the contents of a class each, and nothing
    nothing = len(classes)
    heap, copies = [], {}

    def push(loads: tuple, nodes: tuple, count: int) -> None:
        number = len(copies)
        copies[number] = (loads, nodes, count)
        heapq.heappush(heap, (loads[-1] - loads[0], number))  # loads fall, so this is less the spread

    def joined(x: tuple, y: tuple) -> tuple[tuple, tuple]:
        made = []
        for p in range(parts):
            a, b = x[1][p], y[1][parts - 1 - p]
            if nothing in (a, b):
                node = a if b == nothing else b
            else:
                node = len(kids)
                kids.append((a, b))
            made.append((x[0][p] + y[0][parts - 1 - p], node))
        made.sort(key=lambda m: (-m[0], m[1]))
        return tuple(m[0] for m in made), tuple(m[1] for m in made)

    for i, (work, count) in enumerate(classes):
        if count:
            push((work, *[0] * (parts - 1)), (i, *[nothing] * (parts - 1)), count)
    out = np.zeros((len(classes), parts), np.int64)
    if not heap:
        return out
    while True:
        _, number = heapq.heappop(heap)
        loads, nodes, count = copies.pop(number)
        copies[number] = None  # numbers go on
        if count > 1:
            push(*joined((loads, nodes), (loads, nodes)), count // 2)
            if count % 2:
                push(loads, nodes, 1)
        elif heap:
            _, other = heapq.heappop(heap)
            loads2, nodes2, count2 = copies.pop(other)
            copies[other] = None
            push(*joined((loads, nodes), (loads2, nodes2)), 1)
            if count2 > 1:
                push(loads2, nodes2, count2 - 1)
        else:
            break
    held = np.zeros((len(kids), parts), np.int64)
    for p, node in enumerate(nodes):
        held[node, p] += 1
    for node in range(len(kids) - 1, nothing, -1):
        for kid in kids[node]:
            held[kid] += held[node]
    return held[:nothing]


def times(classes: Classes, counts: np.ndarray, speeds: list[float]) -> np.ndarray:
    """When each part is done."""
    return np.array([w for w, _ in classes], np.float64) @ counts / np.array(speeds)


def searched(classes: Classes, counts: np.ndarray, speeds: list[float], steps: int = 10_000) -> np.ndarray:
    """``counts`` after moves of one copy, or swaps of two, from the part that is done last to another, as long as both are done before it was.

    Each step takes what leaves the later of the two parts done first. The makespan never grows; ``steps`` bounds the search.
    """
    counts, s = counts.copy(), np.array(speeds, np.float64)
    works = np.array([w for w, _ in classes], np.float64)
    rising = np.argsort(works, kind="stable")
    for _ in range(steps):
        t = times(classes, counts, speeds)
        last = int(t.argmax())
        best = (t[last] * (1 - 1e-12), None)
        mine = np.flatnonzero(counts[:, last])
        for p in range(len(s)):
            if p == last:
                continue
            own = rising[counts[rising, p] > 0]
            sizes = works[own].tolist()
            # What the last part gives to even the two out.
            even = (t[last] - t[p]) / (1 / s[last] + 1 / s[p])
            for a in mine:
                at = bisect_left(sizes, works[a] - even)
                for b in [-1, *own[max(0, at - 1) : at + 1].tolist()]:
                    given = works[a] - (works[b] if b >= 0 else 0)
                    later = max(t[last] - given / s[last], t[p] + given / s[p])
                    if given > 0 and later < best[0]:
                        best = (later, (int(a), p, b))
        if best[1] is None:
            break
        a, p, b = best[1]
        counts[a, [last, p]] += [-1, 1]
        if b >= 0:
            counts[b, [last, p]] += [1, -1]
    return counts


def planned(classes: Classes, speeds: list[float], steps: int = 10_000) -> dict[str, np.ndarray]:
    """Counts [class, part] of each method: lpt, differencing, and both searched; differencing gives the heavier contents to faster parts."""
    lpt = np.array(filled_by_time(classes, speeds), np.int64).reshape(len(classes), len(speeds))
    kk = differenced(classes, len(speeds))
    loads = np.array([w for w, _ in classes], np.float64) @ kk
    heavy, fast = np.argsort(-loads, kind="stable"), np.argsort([-x for x in speeds], kind="stable")
    fitted = np.zeros_like(kk)
    fitted[:, fast] = kk[:, heavy]
    return {"lpt": lpt, "lpt+search": searched(classes, lpt, speeds, steps), "differencing": fitted, "differencing+search": searched(classes, fitted, speeds, steps)}


def classes_of(work: DataFrame) -> Classes:
    """The works of (v, work) and how many rows have each, largest first: one row a work on the driver."""
    return [(r["work"], r["c"]) for r in work.groupBy("work").agg(F.count("*").alias("c")).orderBy(F.desc("work")).collect()]


def dealt(work: DataFrame, classes: Classes, counts: np.ndarray) -> DataFrame:
    """v, work, part: the rows of a class in the order of v, dealt to the parts by ``counts``."""
    spans = []
    for (size, _), got in zip(classes, counts.tolist(), strict=True):
        ends = np.cumsum([0, *got]).tolist()
        spans += [(size, lo, hi, p) for p, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if hi > lo]
    base = np.cumsum([0, *[c for _, c in classes]]).tolist()
    spark = work.sparkSession
    first = spark.createDataFrame([(w, b) for (w, _), b in zip(classes, base, strict=False)], "work long, base long")
    ranked = with_position(work.select("v", "work"), [F.desc("work"), F.asc("v")], "r").join(first, "work").withColumn("i", F.col("r") - F.col("base"))
    s = spark.createDataFrame(spans, "work long, lo long, hi long, part long")
    return ranked.join(s, "work").where("i >= lo AND i < hi").select("v", "work", "part")


def packed(work: DataFrame, speeds: list[float], steps: int = 10_000) -> tuple[DataFrame, dict[str, float]]:
    """(v, work, part) by the method of least makespan, the first of equals in the order of ``planned``, and every method's makespan."""
    work = kept(work.select("v", "work"), "work")
    classes = classes_of(work)
    plans = planned(classes, speeds, steps)
    spans = {k: float(times(classes, c, speeds).max()) if classes else 0.0 for k, c in plans.items()}
    best = min(spans, key=spans.__getitem__)
    return dealt(work, classes, plans[best]), spans
