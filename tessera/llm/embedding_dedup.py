"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, asymmetric distances, exact rerank.

A coarse quantiser and one codebook per subspace are fitted on a bounded sample
(``SAMPLE`` vectors, a documented bound); every vector is indexed: in the list of
its nearest centroid, with a code of its residual. A neighbour at distance r lies in another
cell only if it is across the plane between that cell's centroid and the
query's own. Of a difference of length r, the part along one direction is about
r / sqrt(d) where differences fill d dimensions; d is measured on the sample, as
the lesser of what all its differences fill and what those of close vectors do.
A query goes to every list whose plane is within ``SIGMAS`` times that, and never
further than r (at d of 5 or less that is exact), and a link is found if either end's query finds it. In a list, table
lookups give asymmetric distances to the codes; a pair whose distance, less what
the code is off (each vector's quantisation error is stored), may be a link is
reranked by its exact cosine in double precision. So codes lose no link and only
save exact work; probes may lose one (recall is tested at several intrinsic dimensions).

Equal vectors are one node with a weight, so a group of copies costs no more than
one of them. Lists are cut into blocks of ``BLOCK`` nodes by position, queries of
a list into groups, so a list that holds a third of all nodes is many tasks, and
no task gets more than a block and a group. A task doesn't give its links one by
one but each node's number of them and a spanning forest of them. There are at
most ``MAX_LISTS`` lists, as many as the sample can fit: beyond about 260,000
different vectors lists grow longer, and so does the work for each vector.

Defined results: vectors that are null, zero, of another length than most, or
with null or non-finite components link with nothing and are components of their
own; equal vectors (repeated rows too) link; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .sampling import share
from .shared import dropped, freeing, read_table, written

THRESHOLD = 0.95
SAMPLE = 20_000
MAX_LISTS = 1024
SUBSPACES = 8
CODES = 64
BLOCK = 2048
SLACK = 1e-9
SIGMAS = 2.25


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most ``k`` centroids by Lloyd's rounds from distinct rows."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, dtype=np.float64)
    start = np.unique(x, axis=0)
    c = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        count = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = count > 0
        c[full] = total[full] / count[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ c.T).argmin(axis=1)
    return out


def filled(x: np.ndarray, anchors: int = 256, near: int = 24) -> float:
    """How many dimensions the differences of vectors fill: the participation ratio of their covariance, of all or around an anchor, whichever is less."""

    def ratio(c: np.ndarray) -> float:
        return float(np.trace(c) ** 2 / max((c * c).sum(), 1e-300))

    d = x - x.mean(axis=0)
    whole = ratio(d.T @ d)
    if len(x) < 4 * near:
        return max(1.0, whole)
    local = []
    for a in x[:: max(1, len(x) // anchors)][:anchors]:
        far = ((x - a) ** 2).sum(axis=1)
        far[far < 1e-12] = np.inf  # itself and its copies
        d = x[np.argpartition(far, near)[:near]] - a
        d = d - d.mean(axis=0)
        # Of so few differences the ratio is too small by a known amount: 1 / ratio = 1 / d + 1 / (near - 1).
        r = ratio(d @ d.T)
        local.append(1.0 / max(1.0 / r - 1.0 / (near - 1), 1.0 / x.shape[1]))
    return max(1.0, min(whole, float(np.median(local))))


@dataclass
class Quantiser:
    """Coarse centroids and, for each subspace, codewords of residuals."""

    coarse: np.ndarray
    books: np.ndarray  # subspace, code, dimension

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
        coarse = kmeans(x, lists)
        rest = x - coarse[nearest(x, coarse)]
        parts = np.array_split(np.arange(x.shape[1]), subspaces)
        width = max(map(len, parts))
        books = np.zeros((subspaces, codes, width))
        for s, part in enumerate(parts):
            b = kmeans(rest[:, part], codes)
            books[s, :, : len(part)] = np.vstack([b, np.repeat(b[:1], codes - len(b), axis=0)])
        return cls(coarse, books)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(np.arange(x.shape[1]), len(self.books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, quantisation error) of each vector."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        code, off = np.empty((len(x), len(self.books)), dtype=np.uint8), np.zeros(len(x))
        for s, part in enumerate(self.parts(x)):
            book = self.books[s, :, : len(part)]
            code[:, s] = k = nearest(rest[:, part], book)
            off += ((rest[:, part] - book[k]) ** 2).sum(axis=1)
        return at, code, np.sqrt(off)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(axis=1)

    def probes(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for each list whose cell begins within ``margin`` of a vector, its own included."""
        d = self.distances(x)
        own = d.argmin(axis=1)
        return np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * margin * self.apart[own] + SLACK)

    def probed(self, y: np.ndarray, cell: int, lists: np.ndarray, margin: float) -> np.ndarray:
        """Whether each vector of a cell, as a query, goes to the list beside it."""
        far, near = ((y - self.coarse[lists]) ** 2).sum(axis=1), ((y - self.coarse[cell]) ** 2).sum(axis=1)
        return far - near <= 2 * margin * self.apart[cell, lists] + SLACK

    def prepare(self) -> None:
        c = self.coarse
        self.apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1), 0))

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each vector's residual to every codeword: vector, subspace, code."""
        rest = x - self.coarse[at]
        out = np.empty((len(x), len(self.books), self.books.shape[1]))
        for s, part in enumerate(self.parts(x)):
            book = self.books[s, :, : len(part)]
            out[:, s] = np.maximum((rest[:, part] ** 2).sum(1)[:, None] - 2 * rest[:, part] @ book.T + (book * book).sum(1), 0)
        return out


def _unit(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def _usable(column: pa.Array, kind: str, dim: int) -> tuple[list[bytes], np.ndarray]:
    """(bytes of the usable rows' components, their places)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = pa.compute.equal(pa.compute.list_value_length(column), dim).fill_null(False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()) if len(at) else pa.array([], pa.float64())
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return [r.tobytes() for r in x[good].astype(kind)], at[good]


def _forest(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (q, b) as (node, least node of its tree)."""
    nodes, flat = np.unique(np.concatenate([q, b]), return_inverse=True)
    u, v = flat[: len(q)], flat[len(q) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def links(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, n: counts of links to add up; a, b: a spanning forest of the links), from written tables."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "id long, n long, a long, b long"
    if sizes is None or not sizes["n"]:
        empty = spark.createDataFrame([], result)
        return empty.select("id", "n"), empty.select("a", "b")
    dim, total = sizes["n"], sizes["count"]
    lists = int(min(MAX_LISTS, max(1, 2 * round(total**0.5))))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    picked = v.where(share("id") < min(1.0, sample / total)).limit(2 * sample).select("v").toArrow()
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"
    x = _unit(_usable(picked.column("v"), kind, dim)[0], kind, dim)
    if not len(x):
        empty = spark.createDataFrame([], result)
        return empty.select("id", "n"), empty.select("a", "b")
    margin = min(radius, SIGMAS * radius / filled(x) ** 0.5)
    quantiser = Quantiser.fit(x, lists)
    quantiser.prepare()
    shared = spark.sparkContext.broadcast(quantiser)

    @freeing
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            raw, at = _usable(b.column(1), kind, dim)
            if not raw:
                continue
            cell, code, off = q.encode(_unit(raw, kind, dim))
            ids = b.column(0).take(pa.array(at))
            same = pa.array([blake2b(x, digest_size=16).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, same, pa.array(cell), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off), pa.array(raw, pa.binary())], ["id", "same", "cell", "code", "off", "x"]
            )

    rows = written(v.mapInArrow(index, "id long, same binary, cell long, code binary, off double, x binary"), "vectors")
    # Equal vectors are one node, by the least id.
    table = written(rows.groupBy("same").agg(F.min("id").alias("id"), F.count_distinct("id").alias("w"), *[F.first(c).alias(c) for c in ("cell", "code", "off", "x")]), "index")
    copies = written(rows.select("id", "same").join(table.where("w > 1").select("same", F.col("id").alias("rep"), "w"), "same").select("id", "rep", "w").distinct(), "copies")
    dropped(rows)
    # Blocks of a list: as many as its size asks for, dealt by a hash of the id, so that ranks aren't needed.
    count = table.groupBy("cell").agg(F.count("*").alias("c")).select("cell", F.greatest(F.lit(1), F.ceil(F.col("c") / block)).cast("long").alias("blocks"))
    blocked = table.join(F.broadcast(count), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("id", "w", "cell", "block", "code", "off", "x")

    @freeing
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                row, cell = q.probes(_unit(part.column(2).to_pylist(), kind, dim), margin)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(cell.astype(np.int64))], ["id", "w", "x", "cell"])

    # A query meets each block of each probed list; the group spreads the queries of a list that many probe.
    asked = table.select("id", "w", "x").mapInArrow(probe, "id long, w long, x binary, cell long")
    crowd = written(asked, "queries")
    many = crowd.groupBy("cell").agg(F.count("*").alias("c")).select("cell", F.greatest(F.lit(1), F.ceil(F.col("c") / block)).cast("long").alias("groups"))
    grouped = crowd.join(F.broadcast(many.join(count, "cell")), "cell").withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")))
    left = grouped.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cell", "block", "group", "id", "w", "x")
    right = blocked.join(F.broadcast(many), "cell").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("cell", "block", "group", "id", "w", "code", "off", "x")

    def meet(key, one: pa.Table, two: pa.Table) -> pa.Table:
        q = shared.value
        cell = key[0].as_py()
        none = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not one.num_rows or not two.num_rows:
            return none
        (ids, other), (weight, weight_other) = ([t.column(c).to_numpy() for t in (one, two)] for c in ("id", "w"))
        y = _unit(two.column("x").to_pylist(), kind, dim)
        code = np.frombuffer(b"".join(two.column("code").to_pylist()), dtype=np.uint8).reshape(len(y), -1)
        off = two.column("off").to_numpy()
        raw = one.column("x").to_pylist()
        counts, counts_other, us, vs = np.zeros(len(ids), dtype=np.int64), np.zeros(len(other), dtype=np.int64), [], []
        for i in range(0, len(ids), 128):
            x = _unit(raw[i : i + 128], kind, dim)
            t = q.tables(x, cell)
            d = sum(t[:, s][:, code[:, s]] for s in range(code.shape[1]))
            # |x - y| >= |x - code| - |y - code|, so a pair beyond the radius by more than the code's error is no link.
            a, b = np.nonzero(np.sqrt(d) <= radius + off[None, :] + SLACK)
            if not len(a):
                continue
            # One order of summation whatever the block's density, so that a pair at the threshold is judged alike from both ends.
            exact = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], y[b[k : k + 65536]]) for k in range(0, len(a), 65536)]) >= threshold
            a, b = a[exact], b[exact]
            mine = ids[a + i] != other[b]
            a, b = a[mine], b[mine]
            back = q.probed(y[b], cell, nearest(x, q.coarse)[a], margin)
            a += i
            np.add.at(counts, a, weight_other[b])
            np.add.at(counts_other, b[~back], weight[a[~back]])  # this link shows from here only
            us.append(ids[a])
            vs.append(other[b])
        if not us or not sum(map(len, us)):
            return none
        node, root = _forest(np.concatenate(us), np.concatenate(vs))
        ids, counts = np.concatenate([ids, other]), np.concatenate([counts, counts_other])
        some = np.flatnonzero(counts)
        gap = lambda n: pa.nulls(n, pa.int64())
        return pa.concat_tables([pa.table({"id": ids[some], "n": counts[some], "a": gap(len(some)), "b": gap(len(some))}), pa.table({"id": gap(len(node)), "n": gap(len(node)), "a": node, "b": root})])

    by = ["cell", "block", "group"]
    found = written(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, result), "links")
    own = found.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    other = copies.where("id <> rep")
    counts = own.unionAll(copies.select("id", (F.col("w") - 1).alias("n"))).unionAll(other.join(written(own, "counts").withColumnRenamed("id", "rep"), "rep").select("id", "n"))
    return counts, found.where("a IS NOT NULL AND a <> b").select("a", "b").unionAll(other.select("id", "rep"))


def classes(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", column: str = "embedding", **options) -> DataFrame:
    """key, n_links, component_id, kept of every row; rows without an id are kept, with no component."""
    counts, forest = links(vectors, threshold, key, column, **options)
    c = components(forest)
    n = counts.groupBy("id").agg(F.sum("n").alias("n"))
    rows = vectors.select(F.col(key))
    out = rows.join(n.withColumnRenamed("id", key), key, "left").join(c.withColumnRenamed("node", key), key, "left")
    out = out.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col(key).cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
#: All pairs by a plain join: for small tables.
ORACLE_SQL = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept FROM (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) LEFT JOIN n USING (vec_id)
"""
}
