"""Incremental substring dedup over a log-structured index of window fingerprints.

Every window of ``window`` words has a fingerprint: the least hash among its
short word n-grams. Neighbouring windows mostly share it, so a text becomes a
few segments (fingerprint, digest of all words that the segment's windows
cover, document, first window, number of windows). Equal windows have equal
fingerprints, wherever they stand. What decides are 128-bit BLAKE2b digests of
the words themselves, joined by a space.

The index is a set of immutable runs of segments, each sorted by fingerprint
and holding the first document of each distinct segment. A batch of documents,
whose ids follow those of earlier batches, becomes a run of its own and is
merge-joined with the runs before it:

* a segment that an earlier document has in full is a repeat: all its windows go;
* a fingerprint with several distinct segments is contested: the words of these
  segments are read again, and the digests of their windows are compared.

Runs of one level are merged into a run of the next when there are ``fanout``
of them. An index stays where it is written: a later call with its path takes
the documents since, and reads earlier ones (``earlier``) only where a contested
segment of theirs is needed. No step gathers the rows of a key: joins meet
written tables of distinct keys, so that Spark can split a hot one, and hot
fingerprints are counted with partial sums. Bloom filters of fixed size spare
rows that can't have a partner (or a text to change) the shuffle.

Defined results: null and empty texts have no word; texts shorter than a window
lose nothing; rows without an id neither give nor lose words; rows that share an
id are one document: none of them is a copy of the other, and each loses the
windows that stand at its own place in it and in a smaller id. Extra columns of
any name stay as they are; those named as an added column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewise as B
from .bloom import bloom, may_hold
from .shared import dropped, freeing, modest_batches, read_table, release, rows_per_batch, table_path, written

WINDOW = 50
GRAM = 8
FANOUT = 2
#: Batches that a table is taken in, by ranges of ids; the result doesn't depend on it.
BATCHES = 2
#: A segment, its key, and what comes of it: ``ca`` and ``cb`` are the digest of its words.
SEGMENT = "fp long, ca long, cb long, doc_id long, start int, n int"
KEY = ["fp", "ca", "cb"]
RANGE = ["doc_id", "start", "n", "ca"]
#: Columns of joins with the caller's: unlikely names, because his columns may have any.
_ID, _RANGES, _NULL, _GONE = "__substring_id", "__substring_ranges", "__substring_null", "__substring_gone"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _windows(chunk: B.Chunk, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, B.Joined]:
    """(word hashes, first word of each window, its text, where each text's words begin, the words)."""
    w = B.words(chunk)
    h = B.word_hashes(chunk.data, w.start, w.end)
    count = np.diff(w.row)
    of = np.repeat(np.arange(len(count)), np.maximum(count - window + 1, 0))
    before = np.concatenate([[0], np.cumsum(np.maximum(count - window + 1, 0))])
    first = np.arange(before[-1]) - before[of] + w.row[of]
    return h, first, of, w.row, B.Joined(chunk, w)


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, only=None) -> DataFrame:
    """The segments of all texts; with ``only`` (a broadcast filter of ``key``), those whose key it may hold."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in B.chunks(b.column(0)):
                h, first, of, row, words = _windows(c, window)
                if not len(first):
                    continue
                i = np.arange(len(h) - gram + 1)
                fp = B.sliding_min(B.Ranges(h)(i, i + gram), window - gram + 1)[first]
                new = np.ones(len(fp), dtype=bool)
                new[1:] = (fp[1:] != fp[:-1]) | (of[1:] != of[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(fp)))
                start, text = first[at], of[at]
                fp = fp[at]
                ca, cb = words.digests(start, start + n + window - 1)
                if only is not None:
                    keep = only.value.may_hold(B.signed(fp) ^ ca)
                    fp, ca, cb, start, n, text = fp[keep], ca[keep], cb[keep], start[keep], n[keep], text[keep]
                ids = b.column(1).take(pa.array(text + c.lo))
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(fp)), pa.array(ca), pa.array(cb), ids, pa.array((start - row[text]).astype(np.int32)), pa.array(n.astype(np.int32))], [*KEY, "doc_id", "start", "n"])

    return docs.where("doc_id IS NOT NULL").select("text", F.col("doc_id").cast("long")).mapInArrow(run, SEGMENT)


class Index:
    """Sorted immutable runs under one path; ``manifest`` tables say which runs are live."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, runs: list[tuple[int, str]] | None = None):
        self.spark, self.path, self.fanout, self.runs = spark, path.rstrip("/"), fanout, runs or []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, fanout: int = FANOUT) -> Index:
        """The index as the last finished ``add`` left it, empty if there was none."""
        try:
            rows = spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy("version", "at").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []  # nothing was added yet
        last = max((r["version"] for r in rows), default=0)
        out = cls(spark, path, fanout, [(r["level"], r["run"]) for r in rows if r["version"] == last])
        out.version = last
        return out

    def _commit(self) -> None:
        self.version += 1
        rows = [(self.version, i, level, run) for i, (level, run) in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "version int, at int, level int, run string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self) -> DataFrame | None:
        """All live segments; one may be in several runs."""
        runs = [self.spark.read.schema(f"{SEGMENT}, copies long").parquet(f"{self.path}/{run}") for _, run in self.runs]
        return reduce(DataFrame.unionAll, runs) if runs else None

    def _write(self, level: int, segments_: DataFrame) -> str:
        name = f"run-{self.version + 1:06d}-{level}-{len(self.runs)}"
        segments_.sortWithinPartitions(*KEY).write.parquet(f"{self.path}/{name}")
        return name

    def add(self, fresh: DataFrame) -> DataFrame:
        """Write a batch's segments as a run, and return that run."""
        name = self._write(0, first_of_each(fresh.withColumn("copies", F.lit(1).cast("long"))))
        self.runs.append((0, name))
        self._commit()
        return self.spark.read.schema(f"{SEGMENT}, copies long").parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        """Merge the runs of each level that has ``fanout`` of them into one of the next level."""
        level = 0
        while any(l >= level for l, _ in self.runs):
            same = [run for l, run in self.runs if l == level]
            if len(same) >= self.fanout:
                merged = reduce(DataFrame.unionAll, [self.spark.read.schema(f"{SEGMENT}, copies long").parquet(f"{self.path}/{r}") for r in same])
                name = self._write(level + 1, first_of_each(merged))
                self.runs = [(l, r) for l, r in self.runs if l != level] + [(level + 1, name)]
                self._commit()
            level += 1


def first_of_each(s: DataFrame) -> DataFrame:
    """Of equal segments the one in the first document, there the first one; ``copies`` are added up."""
    m = s.groupBy(*KEY).agg(F.min(F.struct("doc_id", "start")).alias("m"), F.max("n").alias("n"), F.sum("copies").alias("copies"))
    return m.select(*KEY, "m.doc_id", "m.start", "n", "copies")


def matches(fresh: DataFrame, history: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments that come again, as key and first document; contested fingerprints; their segments) of a batch's run against earlier ones.

    All are written tables.
    """
    spark = fresh.sparkSession
    if history is None:
        joined = fresh.withColumn("old", F.lit(None).cast("long"))
    else:
        old = history.groupBy(*KEY).agg(F.min("doc_id").alias("old"))
        joined = fresh.hint("merge").join(old, KEY, "left")
    joined = written(joined, "joined")
    again = joined.where("copies > 1 OR old IS NOT NULL").select(*KEY, F.least("old", "doc_id").alias("first"))
    new = joined.where("old IS NULL").drop("old", "copies")
    count = new.groupBy("fp").agg(F.count("*").alias("c"))
    if history is None:
        contested = count.where("c > 1").select("fp")
    else:
        contested = count.join(history.groupBy("fp").agg(F.lit(1).alias("seen")), "fp", "left").where("c > 1 OR seen IS NOT NULL").select("fp")
    contested = written(contested, "contested")
    some = spark.sparkContext.broadcast(bloom(contested))
    sides = new if history is None else new.unionAll(history.drop("copies"))
    return again, contested, written(may_hold(sides, some, "fp").join(contested, "fp", "left_semi").select("doc_id", "start", "n"), "contested-segments")


def _window_hashes(docs: DataFrame, contested: DataFrame, window: int) -> DataFrame:
    """doc_id, at, a, b: 128-bit digests of the windows of contested segments."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(0)):
                w = B.words(c)
                words, at, of = B.Joined(c, w), [], []
                for i in range(c.lo, c.hi):
                    first, stop = w.row[i - c.lo], w.row[i - c.lo + 1]
                    for s in batch.column(2)[i].as_py():
                        # A shorter text that shares the id hasn't all of these windows.
                        some = np.arange(first + s["start"], min(first + s["start"] + s["n"], stop - window + 1))
                        at.append(some)
                        of.append(np.full(len(some), i))
                if not at:
                    continue
                at, of = np.concatenate(at), np.concatenate(of)
                a, b = words.digests(at, at + window)
                ids = batch.column(1).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([ids, pa.array((at - w.row[of - c.lo]).astype(np.int32)), pa.array(a), pa.array(b)], ["doc_id", "at", "a", "b"])

    by_doc = contested.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("s"))
    some = docs.sparkSession.sparkContext.broadcast(bloom(contested.select("doc_id")))
    d = may_hold(docs.where("doc_id IS NOT NULL").select("text", F.col("doc_id").cast("long").alias("doc_id")), some, "doc_id")
    return d.join(by_doc.hint("merge"), "doc_id").select("text", "doc_id", "s").mapInArrow(run, "doc_id long, at int, a long, b long")


def repeats(docs: DataFrame, path: str | None = None, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n, ca: runs of windows, each of which also starts in a document with a smaller id, and half the digest of their words; a written table.

    ``path`` is the index to use and to extend; if it has documents, ``earlier`` must hold them.
    """
    with rows_per_batch(docs.sparkSession, 1000):
        return written(_repeats(docs, path, batches, window, gram, fanout, earlier), "repeats")


def _repeats(docs: DataFrame, path: str | None, batches: int, window: int, gram: int, fanout: int, earlier: DataFrame | None) -> DataFrame:
    spark = docs.sparkSession
    index = Index.open(spark, path, fanout) if path else Index(spark, table_path(spark, "segments"), fanout)
    if index.runs and earlier is None:
        raise ValueError(f"the index at {path} has documents already: give them as earlier")
    numbered = docs.where("doc_id IS NOT NULL")
    cuts = sorted(set(numbered.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *map(int, cuts), None]
    found = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        batch = numbered
        if lo is not None:
            batch = batch.where(F.col("doc_id") >= lo)
        if hi is not None:
            batch = batch.where(F.col("doc_id") < hi)
        history = index.read()
        fresh = index.add(segments(batch, window, gram))
        found.append(matches(fresh, history))
        index.compact()
        release(spark)
    out = confirmed(docs, found, window, gram, earlier)
    release(spark)
    return out


def confirmed(docs: DataFrame, found: list[tuple[DataFrame, DataFrame, DataFrame]], window: int, gram: int, earlier: DataFrame | None = None) -> DataFrame:
    """The repeats that the matches of all batches come to; ``docs`` holds the documents of all of them, ``earlier`` those before."""
    spark = docs.sparkSession
    again, contested, sides = (reduce(DataFrame.unionAll, x) for x in zip(*found, strict=True))
    again = written(again.groupBy(*KEY).agg(F.min("first").alias("first")), "again")
    some = spark.sparkContext.broadcast(bloom(again.select(F.col("fp").bitwiseXOR(F.col("ca")))))
    met = written(segments(docs, window, gram, some).join(again, KEY), "met")
    whole = met.where("doc_id > first").select(*RANGE)
    # A contested segment that its first document has more than once: each of its places is compared.
    more = met.where("doc_id = first").join(contested.distinct(), "fp", "left_semi").select("doc_id", "start", "n")
    every = docs.select("doc_id", "text")
    if earlier is not None:
        every = every.unionByName(earlier.select("doc_id", "text"))
    hashes = written(_window_hashes(every, sides.unionAll(more), window), "windows")
    # A table, so that the join has plain exchanges on both sides: of a passage that very many documents share, Spark splits the rows.
    firsts = written(hashes.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "firsts")
    single = hashes.join(firsts, ["a", "b"]).where("doc_id > first").select("doc_id", F.col("at").alias("start"), F.lit(1).alias("n"), F.col("a").alias("ca"))
    if earlier is not None:
        single = single.join(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    return whole.unionAll(single)


def _cut(docs: DataFrame, removed: DataFrame, window: int, make, added: str) -> DataFrame:
    """``make(text, words, mask of removed words or None)`` gives the values of the added columns of each row; equally named ones go.

    Only rows that may have something removed are shuffled to meet their ranges.
    """
    spark = docs.sparkSession
    types = spark.createDataFrame([], added).schema
    names = ["text", *[c for c in docs.columns if c != "text" and c not in types.names]]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names[1:]] + [added])
    out_names = [*names[1:], *types.names]
    # The ranges of a document are at most as many as its words.
    ranges = written(removed.groupBy(F.col("doc_id").alias(_ID)).agg(F.collect_set(F.struct("start", "n", "ca")).alias(_RANGES)), "ranges")
    some = spark.sparkContext.broadcast(bloom(ranges.select(_ID)))
    kinds = [{"long": pa.int64(), "string": pa.string()}[f.dataType.typeName()] for f in types]

    def rows(b: pa.RecordBatch, at: int | None) -> pa.RecordBatch:
        values: list[tuple] = []
        for i in range(b.num_rows):
            text = b.column(0)[i].as_py() or ""
            mask, spans, r = None, None, b.column(at)[i].as_py() if at is not None else None
            if r:
                spans = [m.span() for m in _WORD.finditer(text)]
                words = [text[x:y] for x, y in spans]
                # Rows that share an id may have other texts: a range counts where it has the words that were compared.
                own = [(s["start"], stop) for s in r if (stop := s["start"] + s["n"] + window - 1) <= len(words) and B.digest_of(words[s["start"] : stop]) == s["ca"]]
                edge = np.zeros(len(spans) + 1, dtype=np.int64)
                for x, y in own:
                    edge[x] += 1
                    edge[y] -= 1
                mask = np.cumsum(edge[:-1]) > 0 if own else None
            values.append(make(text, spans, mask))
        cols = [pa.array(v, k) for v, k in zip(zip(*values, strict=True), kinds, strict=True)] if values else [pa.array([], k) for k in kinds]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in range(1, len(names))), *cols], out_names)

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in B.chunks(b.column(0)):
            yield b.slice(c.lo, c.hi - c.lo)

    @freeing
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("doc_id")
        for b in batches:
            ids = b.column(at)
            hit = some.value.may_hold(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            for p in parts(b.filter(pa.array(~hit))):
                yield rows(p, None)

    @freeing
    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in parts(b):
                yield rows(p, len(names))

    met = may_hold(modest_batches(docs).select(*names), some, "doc_id").withColumn(_ID, F.col("doc_id").cast("long"))
    met = met.join(ranges.hint("merge"), _ID, "left").select(*names, _RANGES)
    return docs.select(*names).mapInArrow(untouched, schema).unionAll(met.mapInArrow(touched, schema))


def kept_text(text: str, spans: list[tuple[int, int]] | None, mask: np.ndarray | None) -> str:
    """The text without its removed words; what stood before and after a removed run is on lines of its own."""
    if mask is None:
        return text
    edge = np.flatnonzero(np.diff(np.concatenate([[1], mask.astype(np.int8), [1]])))
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in zip(edge[::2], edge[1::2], strict=True))


def deduplicated(docs: DataFrame, window: int = WINDOW, removed: str = "n_removed", **options) -> DataFrame:
    """``docs`` with texts cut, and the number of removed words, which replaces a column named ``removed``; rows that lose their last word go."""

    def make(text, spans, mask):
        return kept_text(text, spans, mask), 0 if mask is None else int(mask.sum()), 1 if mask is not None and mask.all() else 0

    kept = [c for c in docs.columns if c != removed]
    out = _cut(docs.select(*kept).withColumn(_NULL, F.col("text").isNull()), repeats(docs, window=window, **options), window, make, f"text string, `{removed}` long, {_GONE} long")
    return out.where(f"{_GONE} = 0").withColumn("text", F.when(~F.col(_NULL), F.col("text"))).select(*kept, removed)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")

    def make(text, spans, mask):
        words = _WORD.findall(text)
        kept = words if mask is None else [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
        return len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()

    return _cut(docs, repeats(docs), WINDOW, make, "n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
#: Every window as text: for small tables.
ORACLE_SQL = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM g JOIN f USING (g) WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
}
