"""Divergence of the sources of a language: group-block by group-block tiles over packed count vectors.

A group is a language and a source. A language keeps the terms that enough of
its documents hold; each group's counts of them are packed by chunks of the
vocabulary. Groups are dealt into blocks, and each vector is replicated to the
tiles (pairs of blocks) its block is part of. A task has one tile and one run
of chunks: it unpacks chunk after chunk into a small matrix and adds up what
each pair of its groups differs by there. Sums over the runs give the pairs.
What a task holds is bounded by ``BLOCK``, ``CHUNK`` and ``SPAN``, whatever the
number of sources, terms or documents. A chunk counts only where a group of
the tile has a term of it; all other terms differ by the same amount, which is
multiplied.

All arithmetic is in integers: a share is ``1 + floor(SCALE * (n + 1) / (N + V))``,
exact for up to 2.8e14 occurrences in a group.

Defined results: null text, language and source count as empty strings; every
group that occurs is compared, with or without terms; repeated rows count as
often as they are there; ties in a value go by the item's UTF-8 bytes; a
language of one source has no pairs; an empty table gives no rows; columns
other than the three are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewise as B
from .shared import dropped, freeing, modest_batches, read_table, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Groups of a block, terms of a chunk, chunks that a task goes through.
BLOCK, CHUNK, SPAN = 8, 1024, 16
#: Bytes of text that are counted at once, and (group, term) counts that a task holds before it passes them on.
TEXT_BYTES, MOST = 1 << 21, 1 << 22
_NO_TERM = np.array([b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 for b in range(256)])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term: occurrences ``n`` and documents ``d``, counted in each task before rows are shuffled."""
    d = modest_batches(docs.select(*_group(), F.coalesce("text", F.lit("")).alias("text")))
    return d.mapInArrow(_counted, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


@freeing
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for b in batches:
        groups = np.array([counts.group(g) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
        for c in B.chunks(b.column(2), TEXT_BYTES):
            counts.add(c, groups[c.lo : c.hi])
            if counts.full():
                yield from counts.rows()
                counts = Counts(counts)
    yield from counts.rows()


class Counts:
    """Occurrences and documents of (group, term) in what a task has read: terms are told apart by their bytes."""

    def __init__(self, before: Counts | None = None):
        self.groups: dict[tuple[str, str], int] = before.groups if before else {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.least = 0

    def group(self, name: tuple[str, str]) -> int:
        return self.groups.setdefault(name, len(self.groups))

    def full(self) -> bool:
        if self.size > max(1 << 20, 2 * self.least):
            self.parts = [self.total()]
            self.size = self.least = len(self.parts[0][0])
        return self.least > MOST

    def add(self, c: B.Chunk, groups: np.ndarray) -> None:
        data = B.lowered(c.data)
        w = B.words(B.Chunk(c.lo, c.hi, data, c.offsets), _NO_TERM)
        if not len(w.start):
            return
        at = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(w.start), [None, pa.py_buffer(at), pa.py_buffer(data[~_NO_TERM[data]])]).dictionary_encode()
        names = np.array([self.terms.setdefault(t, len(self.terms)) for t in found.dictionary.to_pylist()], np.int64)
        of = np.repeat(np.arange(c.hi - c.lo), np.diff(w.row))
        key, n = np.unique(of * len(names) + found.indices.to_numpy(), return_counts=True)
        self.parts.append((groups[key // len(names)] << 32 | names[key % len(names)], n, np.ones(len(n), np.int64)))
        self.size += len(n)

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n, d = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(n[order], first), np.add.reduceat(d[order], first)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        key, n, d = self.total()
        names = [pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1)]
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        for a in range(0, len(key), 1 << 16):
            k = key[a : a + (1 << 16)]
            of, term = pa.array(k >> 32), pa.array(k & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([names[0].take(of), names[1].take(of), terms.take(term), pa.array(n[a : a + len(k)]), pa.array(d[a : a + len(k)])], ["lang", "source", "term", "n", "d"])


def _group() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]


def _share(n: str, total: str) -> Column:
    """The share of ``n`` with one added, in parts of ``SCALE``; decimals, as the product may pass 64 bits."""
    return F.expr(f"1 + CAST({SCALE} AS decimal(10, 0)) * CAST({n} + 1 AS decimal(19, 0)) div CAST({total} AS decimal(19, 0))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``_share`` of a matrix, a row for each group: two steps, so that no product passes 64 bits."""
    a, b = 31_250, SCALE // 31_250
    x, t = (counts + 1) * a, totals[:, None]
    return 1 + x // t * b + x % t * b // t


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums for each ordered pair of groups of a tile over the chunks of one run, and the number of terms in them."""
    lang, one, other = key[0].as_py(), key[1].as_py(), key[2].as_py()
    rows = rows.sort_by([("chunk", "ascending"), ("source", "ascending")]).combine_chunks()
    chunk = rows["chunk"].to_numpy()
    n_groups = int(np.searchsorted(chunk, 0))  # each group has one row without a chunk, and these come first
    names = rows["source"].slice(0, n_groups).to_pylist()
    at = {s: i for i, s in enumerate(names)}
    block, total, kept = (rows[c].slice(0, n_groups).to_numpy() for c in ("block", "total", "kept"))
    sides = [(np.flatnonzero(block == one), np.flatnonzero(block == other))]
    if one != other:
        sides.append(sides[0][::-1])
    sums, seen, lo = np.zeros((n_groups, n_groups), np.int64), 0, n_groups
    while lo < len(chunk):
        hi = int(np.searchsorted(chunk, chunk[lo], side="right"))
        part = rows.slice(lo, hi - lo)
        of = np.repeat([at[s] for s in part["source"].to_pylist()], part["pos"].combine_chunks().value_lengths().to_numpy())
        terms, place = np.unique(part["pos"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        counts = np.zeros((n_groups, len(terms)), np.int64)
        counts[of, place] = part["n"].combine_chunks().flatten().to_numpy()
        p = shares(counts, total + kept)
        for rows_of, columns in sides:
            for g in rows_of:
                apart = p[columns] - p[g]
                sums[g, columns] += (apart * apart // p[columns]).sum(axis=1)
        seen, lo = seen + len(terms), hi
    g, h = (np.concatenate(x) for x in zip(*[(np.repeat(a, len(b)), np.tile(b, len(a))) for a, b in sides], strict=True))
    g, h = g[g != h], h[g != h]
    name = lambda i: pa.array([names[k] for k in i], pa.string())
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": name(g), "item": name(h), "total": total[g], "other": total[h], "kept": kept[g], "sum": sums[g, h], "seen": np.full(len(g), seen, np.int64)})


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and the exact sum of their gaps over all kept terms."""
    packed = cells.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "n")).alias("x"))  # at most CHUNK
    packed = packed.select("lang", "source", "chunk", F.col("x.pos").alias("pos"), F.col("x.n").alias("n"), F.expr(f"chunk div {SPAN}").cast("int").alias("span"))
    of = groups.select("lang", "source", "block", "blocks", "spans", "total", "kept")
    empty = [F.array().cast("array<int>").alias("pos"), F.array().cast("array<bigint>").alias("n")]
    heads = of.select("*", F.lit(-1).alias("chunk"), *empty, F.explode(F.sequence(F.lit(0), F.col("spans") - 1)).alias("span"))
    vectors = heads.unionByName(packed.join(of, ["lang", "source"]))
    tiles = vectors.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("lang", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "span", "source", "block", "total", "kept", "chunk", "pos", "n")
    sums = tiles.groupBy("lang", "one", "other", "span").applyInArrow(_tile, "lang string, source string, item string, total long, other long, kept long, sum long, seen long")
    out = sums.groupBy("lang", "source", "item", "total", "other", "kept").agg(F.sum("sum").alias("sum"), (F.col("kept") - F.sum("seen")).alias("rest"))
    out = out.withColumns({"p": F.when(F.col("kept") > 0, _share("0", "total + kept")), "q": F.when(F.col("kept") > 0, _share("0", "other + kept"))})
    value = F.when(F.col("kept") > 0, F.col("sum") + F.col("rest") * _gap("p", "q")).otherwise(F.lit(0))
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))


def _terms(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (a term the group uses more than its language does) and the gap."""
    t = cells.join(groups.select("lang", "source", "total", "all", "kept"), ["lang", "source"])
    t = t.withColumns({"p": _share("n", "total + kept"), "q": _share("uses", "all + kept")}).where("p > q")
    return t.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").cast("long").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources, and the ``top`` terms, of each group."""
    counts = written(term_counts(docs), "divergence-counts")
    vocabulary = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("uses"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d"), "divergence-terms")
    sizes = written(vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("uses").alias("all")), "divergence-sizes")
    n_chunks = F.ceil(F.col("kept") / CHUNK)
    place = vocabulary.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), n_chunks).cast("int"))
    # Dealt out by chunk, not by language: a language's terms are no one task's.
    place = place.repartition("lang", "chunk").withColumn("pos", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    cells = written(counts.join(place.select("lang", "term", "uses", "chunk", "pos"), ["lang", "term"]).select("lang", "source", "term", "n", "uses", "chunk", "pos"), "divergence-cells")
    groups = docs.select(*_group()).distinct()
    of_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "all"]).withColumns({"block": F.pmod(F.xxhash64("source"), "blocks").cast("int"), "spans": F.greatest(F.lit(1), F.ceil(F.ceil(F.col("kept") / CHUNK) / SPAN)).cast("int")})
    groups = written(groups, "divergence-groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = _pairs(groups, cells).withColumn("rank", rank)
    out = written(pairs.unionByName(_terms(groups, cells).withColumn("rank", rank).where(F.col("rank") <= top)), "divergence")
    dropped(counts, vocabulary, sizes, cells, groups)
    return out


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS nn FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 1)) // (nn + v) AS p
      FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT c.lang, c.term, 1 + ({SCALE}::HUGEINT * (sum(n) + 1)) // ((SELECT sum(nn) FROM gn WHERE gn.lang = c.lang) + any_value(v)) AS q
      FROM c JOIN v USING (lang) GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
                 FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
      ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= {TOP}
"""


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {"op13_source_divergence": _sql()}
