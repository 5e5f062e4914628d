"""N-gram Jaccard self-join by rare-first prefix filtering.

A text is the set of its distinct word shingles. Equal sets are one node.
Shingles are ordered rare first: those that come often by their counts, behind
all others. Two sets that meet the threshold share a shingle among the first
``n - ceil(t * n) + 1`` of each, so nodes are joined on these prefixes only;
pairs must pass the length and the positional filter within the join, then,
once per pair, the suffix filter and the exact count, for which the texts of the
pairs' nodes alone are read again. The suffix filter halves two sets by the
middle element of the one, again and again: where the parts' sizes differ, so
many elements aren't shared. Before whole sets are moved, two coarser forms of
it use what a node carries of its set: in the join of the last round
``64 * LONGS`` bits, one for each hash range that the set has an element in, and
then the numbers of elements in ``RANGES`` hash ranges.

Groups of many near copies share whole prefixes. So that no group's pairs are
all emitted, links are gathered in rounds: while there are too many pairs of
different components, each prefix shingle only pairs its nodes with one hub of
its own; links found join components, and pairs within a component need no
test, because they can't change it. The last round tests every pair that is
left. No candidate is dropped, and no link between components is lost.

Counts of shingles are lossy counts: each task counts all its shingles in
blocks and reports those that it saw more than once. A shingle is frequent from
``FREQUENT`` of all shingles on, so there are at most ``1 / FREQUENT`` of them,
whatever the input's size; that table is broadcast. It orders, and it says which
shingles are dealt out over ``SALTS`` tasks where shared ones are picked: it
decides no result.

Defined results: null, empty and wordless texts have the empty set and link with
nothing; with fewer words than a shingle has, the whole sequence is the one
shingle; repeated rows are copies; nodes are told apart by 64-bit digests of
their sets; rows without an id belong to the component of a row with an equal
set, to none where there is none; rows that share an id but not a text are
documents of their own under that id. Columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewise as B
from .bloom import bloom, may_hold
from .components import components
from .shared import dropped, freeing, read_table, release, rows_per_batch, written

SHINGLE = 5
#: The threshold is 100 * intersection >= PERCENT * union.
PERCENT = 75
FREQUENT = 2.0**-20
#: Rounds with hubs, and how many pairs per prefix row the round that tests all may have.
HUB_ROUNDS = 6
#: A round with hubs that finds fewer links than this share of the nodes is the last of them.
FEW_LINKS = 0.01
PAIRS_PER_ROW = 2.0
COUNT_BLOCK = 1_000_000
LONGS = 16
RANGES = 512
#: Tasks that the prefix rows of a frequent shingle are dealt out to, and how often the suffix filter halves.
SALTS = 64
HALVINGS = 4


def shingle_sets(chunk: B.Chunk, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    data = B.lowered(chunk.data)
    w = B.words(chunk)
    r = B.Ranges(B.word_hashes(data, w.start, w.end))
    n = len(w.start)
    every = r(np.arange(max(n - size + 1, 0)), np.arange(size, n + 1)) if n >= size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(w.row[:-1].tolist(), w.row[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(r(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed number; 0 for the empty set."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        h = B.mix(np.array([B.mix(tokens).sum() + np.uint64(len(tokens)) * np.uint64(0x9FB21C651E98DF25)], dtype=np.uint64))
    return int(h.view(np.int64)[0])


def signature(tokens: np.ndarray) -> np.ndarray:
    """LONGS numbers whose bits say which hash ranges a set has an element in."""
    bits = np.zeros(64 * LONGS, dtype=np.uint8)
    bits[(tokens >> np.uint64(54)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def range_counts(tokens: np.ndarray) -> bytes:
    """How many hashes of a set are in each range; 255 stands for any more."""
    return np.minimum(np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def least_overlap(n: np.ndarray, m: np.ndarray | int, percent: int = PERCENT) -> np.ndarray:
    """The least intersection of sets of n and m elements that meets the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


#: Columns of joins with the caller's: unlikely names, because his columns may have any.
_ID, _HASH = "__jaccard_id", "__jaccard_hash"


def _surveyed(docs: DataFrame, size: int) -> DataFrame:
    """One pass: doc_id, hash, n, d and signature of each text, and (tok, cnt) of the shingles that a task saw in several sets; a written table."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total, seen = 0, set()
        names = ["doc_id", "hash", "n", "d", "sig", "ranges", "tok", "cnt"]

        def counts() -> pa.RecordBatch:
            tok, cnt = np.unique(np.concatenate(held), return_counts=True)
            tok, cnt = tok[cnt > 1], cnt[cnt > 1]
            empty = pa.nulls(len(tok), pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(len(tok), pa.list_(pa.int64())), pa.nulls(len(tok), pa.binary()), pa.array(B.signed(tok)), pa.array(cnt.astype(np.int64))], names)

        for b in batches:
            for c in B.chunks(b.column(0)):
                sets = shingle_sets(c, size)
                d = [digest(s) for s in sets]
                for s, x in zip(sets, d, strict=True):
                    if x not in seen:
                        seen.add(x)
                        held.append(s)
                        total += len(s)
                empty = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(c.lo, c.hi - c.lo) for k in (1, 2)), pa.array([len(s) for s in sets], pa.int64()), pa.array(d, pa.int64()), pa.array([signature(s) for s in sets], pa.list_(pa.int64())), pa.array([range_counts(s) for s in sets], pa.binary()), empty, empty], names)
                if total > COUNT_BLOCK:
                    yield counts()
                    held, total, seen = [], 0, set()
        if held:
            yield counts()

    return written(docs.select("text", F.col("doc_id").cast("long"), F.xxhash64("text")).mapInArrow(run, "doc_id long, hash long, n long, d long, sig array<long>, ranges binary, tok long, cnt long"), "survey")


class Order:
    """Rare first: frequent shingles come last, by count; ties and the others by hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        o = np.argsort(tokens)
        self.tokens, self.counts = tokens[o], counts[o]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.tokens >> np.uint64(42)] = True

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """``tokens`` (sorted by hash) in this order, and how many of them, the first ones, aren't frequent."""
        if not len(self.tokens) or not len(tokens):
            return tokens, len(tokens)
        at = np.flatnonzero(self.maybe[tokens >> np.uint64(42)])
        i = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
        hit = self.tokens[i] == tokens[at]
        if not hit.any():
            return tokens, len(tokens)
        often = np.zeros(len(tokens), dtype=bool)
        often[at[hit]] = True
        return np.concatenate([tokens[~often], tokens[often][np.argsort(self.counts[i[hit]], kind="stable")]]), int((~often).sum())


def _prefixes(docs: DataFrame, order, size: int, percent: int) -> DataFrame:
    """tok, d, pos: each text's prefix, pos being -1 - pos where tok is frequent; a set that a task met before isn't given again."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seen = order.value, set()
        for b in batches:
            for c in B.chunks(b.column(0)):
                tok, d, pos = [], [], []
                for s in shingle_sets(c, size):
                    x = digest(s)
                    if not len(s) or x in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(x)
                    p = prefix_length(len(s), percent)
                    ordered, rare = by(s)
                    at = np.arange(p, dtype=np.int32)
                    tok.append(ordered[:p])
                    d.append(np.full(p, x))
                    pos.append(np.where(at < rare, at, -1 - at))
                if tok:
                    cols = [B.signed(np.concatenate(tok)), *map(np.concatenate, (d, pos))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["tok", "d", "pos"])

    return docs.select("text").mapInArrow(run, "tok long, d long, pos int")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """d, s: the sorted hashes, as bytes, of nodes (d, doc_id: one document that has the set); a written table."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in B.chunks(b.column(0)):
                wanted = b.column(1)
                # Rows that share an id may have other texts: the digest decides.
                rows = [(x, s.tobytes()) for i, s in enumerate(shingle_sets(c, size), c.lo) if (x := digest(s)) == wanted[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["d", "s"])

    some = docs.sparkSession.sparkContext.broadcast(bloom(nodes.select("doc_id")))
    few = may_hold(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), some, "doc_id").join(nodes.select("doc_id", "d").hint("merge"), "doc_id")
    return written(few.select("text", "d").mapInArrow(run, "d long, s binary"), "sets")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that pass the suffix filter by range counts."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, RANGES) for k in (2, 4))
            n, m = (batch.column(k).to_numpy() for k in (3, 5))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64) + ((x == 255) & (y == 255)).any(axis=1) * (1 << 40)
            yield batch.select([0, 1]).filter(pa.array(most >= least_overlap(n, m, percent)))

    # Both sides are one exchange: their columns have other names than the table's.
    one, two = nodes.select(F.col("d").alias("a"), F.col("ranges").alias("x"), F.col("n").alias("nx")), nodes.select(F.col("d").alias("b"), F.col("ranges").alias("y"), F.col("n").alias("ny"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "nx", "y", "ny").mapInArrow(run, "a long, b long")


def most_shared(x: np.ndarray, y: np.ndarray, halvings: int = HALVINGS) -> int:
    """An upper bound of the elements that two sorted sets share: the suffix filter's, by halving."""
    if not halvings or not len(x) or not len(y):
        return min(len(x), len(y))
    i = len(y) // 2
    j = int(np.searchsorted(x, y[i]))
    return most_shared(x[:j], y[:i], halvings - 1) + most_shared(x[j:], y[i:], halvings - 1)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that meet the threshold."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)
                if most_shared(x, y) < least_overlap(len(x), len(y), percent):
                    continue
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    one, two = sets.select(F.col("d").alias("a"), F.col("s").alias("x")), sets.select(F.col("d").alias("b"), F.col("s").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _distinct_pairs(live: DataFrame, other: DataFrame, last: bool, percent: int) -> DataFrame:
    """a < b of rows of one shingle (tok1, d1, n1, pos1, label1 and tok2, e, m, qos, other) that pass the length and the positional filter, once each.

    In the last round both sides hold all rows: each pair comes from its lesser
    end, rows carry bits of their sets (s01.., t0..) for the suffix filter, and a
    pair whose ends have the same shingle before this one (before1, tefore) has
    come at that one, where the positional filter passes if it passes here.
    """
    c = F.col
    least = F.ceil(F.lit(percent) * (c("n1") + c("m")) / F.lit(100 + percent))
    ok = (c("label1") != c("other")) & (100 * F.least("n1", "m") >= percent * F.greatest("n1", "m")) & (1 + F.least(c("n1") - c("pos1") - 1, c("m") - c("qos") - 1) >= least)
    if last:
        alone = lambda x, y: reduce(lambda p, q: p + q, [F.bit_count(c(x.format(i)).bitwiseAND(F.bitwise_not(c(y.format(i))))) for i in range(LONGS)])
        ok = (c("d1") < c("e")) & ~F.coalesce(c("before1") == c("tefore"), F.lit(False)) & ok & (c("n1") - alone("s{}1", "t{}") >= least) & (c("m") - alone("t{}", "s{}1") >= least)
    joined = live.join(other, (c("tok1") == c("tok2")) & ok)
    return joined.select(F.least("d1", "e").alias("a"), F.greatest("d1", "e").alias("b")).distinct()


def _told_apart(shared: DataFrame) -> DataFrame:
    """Prefix rows without shingles that have the very nodes of a rarer one.

    Nodes agree on the order of shingles, so of shingles with equal nodes the one
    that comes first in one node comes first in all: it finds the same pairs at
    places that the positional filter leaves through most easily.
    """
    by = shared.groupBy("tok").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("d")).alias("h"), F.sum(F.shiftright(F.xxhash64("d", F.lit(1)), 24)).alias("g"), F.min(F.struct("d", "pos")).alias("m"))
    first = by.groupBy("c", "h", "g", "m.d").agg(F.min(F.struct("m.pos", "tok")).alias("f")).select("f.tok")
    return shared.join(first, "tok", "left_semi")


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash (xxhash64 of the text), n_shingles, d (digest of the set), component (the least id that links reach) of every row."""
    with rows_per_batch(docs.sparkSession, 1000):
        return _classes(docs, size, percent)


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    survey = _surveyed(docs, size)
    rows = survey.where("n IS NOT NULL").select("doc_id", "hash", "n", "d")
    total = rows.agg(F.sum("n")).first()[0] or 0
    often = survey.where("tok IS NOT NULL").groupBy("tok").agg(F.sum("cnt").alias("c")).where(F.col("c") >= max(3.0, FREQUENT * total)).toArrow()
    order = spark.sparkContext.broadcast(Order(often.column("tok").to_numpy().view(np.uint64), often.column("c").to_numpy()))
    firsts = survey.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("doc_id"))

    # Prefix rows of shingles that several nodes have. Frequent shingles are taken to be shared, so that their rows
    # needn't meet in one task; the others have too few rows to be a hot key.
    span = "PARTITION BY tok, salt"
    prefixes = _prefixes(docs, order, size, percent).selectExpr("tok", "d", "pos", f"IF(pos < 0, pmod(d, {SALTS}), -1) AS salt")
    prefixes = prefixes.selectExpr("*", f"min(d) OVER ({span}) AS low", f"max(d) OVER ({span}) AS high").where("salt >= 0 OR low < high")
    several = written(prefixes.groupBy("tok", "salt", "d").agg(F.min(F.expr("IF(pos < 0, -1 - pos, pos)")).alias("pos")).drop("salt"), "prefixes")
    del prefixes
    release(spark, last=True)
    shared = written(_told_apart(several).join(survey.where("n > 0").groupBy("d").agg(F.max("n").cast("int").alias("n")), "d").select("tok", "d", "pos", "n"), "live")
    dropped(several)
    release(spark)
    n_rows = shared.count()
    known = survey.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("ranges").alias("ranges"))
    nodes = written(shared.select("d").distinct().join(known, "d"), "nodes")
    labels = nodes.select("d", F.col("d").alias("label"))
    tested = None
    few = False
    for k in range(HUB_ROUNDS + 1):
        labelled = shared.join(labels, "d")
        mixed = labelled.groupBy("tok", "label").agg(F.count("*").alias("c")).groupBy("tok").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).where("pairs > 0")
        mixed = written(mixed, "mixed")
        left = mixed.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        last = k == HUB_ROUNDS or left <= PAIRS_PER_ROW * n_rows or few
        # Labels only merge: a shingle whose nodes are of one component is done with.
        before, shared = shared, written(shared.join(mixed.select("tok"), "tok", "left_semi"), "live")
        dropped(before, mixed)
        theirs = [F.col("d").alias("e"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("label").alias("other")]
        if last:
            after = shared.withColumn("before", F.lag("tok").over(Window.partitionBy("d").orderBy("pos")))
            live = after.join(nodes.join(labels, "d").select("d", "label", *[F.coalesce(F.get("sig", F.lit(i)), F.lit(0)).alias(f"s{i}") for i in range(LONGS)]), "d")
            # Both sides are one exchange: the same columns in one order, under other names.
            names = ["tok", "before", "d", "n", "pos", "label", *(f"s{i}" for i in range(LONGS))]
            other = live.select(*[F.col(a).alias(b) for a, b in zip(names, ["tok2", "tefore", "e", "m", "qos", "other", *(f"t{i}" for i in range(LONGS))], strict=True)])
            live = live.select(*[F.col(a).alias(f"{a}1") for a in names])
        else:
            live = shared.join(labels, "d")
            other = live.groupBy(F.col("tok").alias("tok2")).agg(F.min(F.struct(F.xxhash64("d", F.lit(k)).alias("h"), *theirs)).alias("hub")).select("tok2", "hub.*")
            live = live.select(*[F.col(a).alias(f"{a}1") for a in ("tok", "d", "n", "pos", "label")])
        pairs = _distinct_pairs(live, other, last, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        release(spark)
        tested = pairs if tested is None else tested.unionAll(pairs)
        possible = written(_possible(pairs, nodes, percent), "possible")
        release(spark)
        found = _verified(docs, possible, nodes, size, percent)
        release(spark)
        labels = _merged(labels, found)
        release(spark)
        if last:
            break
        few = found.count() < FEW_LINKS * nodes.count()
    # A table: a large component is a hot key of the join with it, which Spark can split only without the sums of an aggregate there.
    least = written(labels.join(nodes, "d").groupBy("label").agg(F.min("doc_id").alias("component")), "least")
    of_node = firsts.join(labels, "d", "left").join(least, "label", "left").select("d", F.coalesce("component", "doc_id").alias("component"))
    out = rows.join(written(of_node, "classes"), "d", "left")
    return out.select("doc_id", "hash", F.col("n").alias("n_shingles"), "d", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The links among ``pairs``: the sets of their nodes are read for it and dropped again; a written table."""
    asked = pairs.select(F.col("a").alias("d")).unionAll(pairs.select(F.col("b").alias("d"))).distinct()
    asked = written(nodes.join(asked, "d", "left_semi").where("doc_id IS NOT NULL").select("doc_id", "d"), "asked")
    sets = _sets(docs, asked, size)
    with rows_per_batch(docs.sparkSession, 512):
        found = written(_linked(pairs, sets, percent), "links")
    dropped(sets, asked, pairs)
    return found


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """d, label with the components of new links among the labels joined; links of one pair of labels count once."""
    one, two = labels.select(F.col("d").alias("a"), F.col("label").alias("la")), labels.select(F.col("d").alias("b"), F.col("label").alias("lb"))
    between = links.join(one, "a").join(two, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    c = components(between).select(F.col("node").alias("label"), "component")
    return written(labels.join(c, "label", "left").select("d", F.coalesce("component", "label").alias("label")), "node-labels")


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; rows without an id stay, rows that repeat an id and a text stay once."""
    kept = classes(docs.select("doc_id", "text"), size, percent).where("doc_id = component").select(F.col("doc_id").alias(_ID), F.col("hash").alias(_HASH)).distinct()
    own = docs.where("doc_id IS NOT NULL").withColumns({_ID: F.col("doc_id").cast("long"), _HASH: F.xxhash64("text")})
    first = own.join(kept, [_ID, _HASH], "left_semi").dropDuplicates([_ID, _HASH])
    return first.select(*docs.columns).unionAll(docs.where("doc_id IS NULL"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
#: All pairs that share a shingle: for small tables.
ORACLE_SQL = {
    "op3_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""
}
