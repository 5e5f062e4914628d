"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is the log-odds of its use in toxic against clean documents.
Counts have a Dirichlet prior whose mean comes from a shorter prefix of the
token, so words that were never seen lean on their stems. A linear-time scan
(Ruzzo and Tompa) over the scores, less a drift, finds every maximal segment;
their scores are normalised by the extreme-value law of chance segments
(Karlin and Altschul) with the document's length, the best sum of the first r
segments gives one significance, and a logistic curve fitted on other labelled
rows turns that into a probability.

Fitting reads at most about ``PER_CLASS`` labelled documents of each class (a
documented bound); the fitted model has at most ``MAX_FEATURES`` features.
Scoring is a map over whole texts: no shuffle, no state, memory bounded by one
chunk of texts.

Defined results: null and empty texts have no segment and get the score of a
text without evidence; repeated rows each get their row; without labels of both
classes every score is the share of toxic labels, within 0.001 and 0.999 (0.001 where
there are none: then nothing is rejected).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewise as B
from .sampling import bounded, fold
from .shared import freeing, modest_batches, read_table, written

PER_CLASS = 10_000
MAX_FEATURES = 100_000
#: Prior strength of each level, the prefixes (in bytes) that words lean on, and how far a token's counts must stand out.
PRIOR = 5.0
PREFIXES = (4, 5, 6, 8)
MIN_COUNT = 4
MIN_LOG_ODDS = 2.0
MIN_Z = 4.0
DRIFT = 0.08
CAP = 60.0

_DROP = 1
_MAP = np.full(256, _DROP, dtype=np.uint8)
_MAP[list(B.SEPARATORS)] = 32
_MAP[65:91] = np.arange(97, 123)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def features(chunk: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each word's prefixes and of the word itself: one row a level, where each text's words begin).

    Words are runs of letters; A-Z count as a-z, other ASCII marks inside a word are left out.
    A level is 0 where the word is not longer than the prefix.
    """
    mapped = _MAP[chunk.data]
    keep = mapped != _DROP
    at = np.concatenate([[0], np.cumsum(keep)])[chunk.offsets]
    c = B.Chunk(chunk.lo, chunk.hi, mapped[keep], at)
    w = B.words(c)
    size = w.end - w.start
    levels = [np.where(size > k, B.word_hashes(c.data, w.start, np.minimum(w.start + k, w.end)) ^ np.uint64(k), np.uint64(0)) for k in PREFIXES]
    return np.stack([*levels, B.word_hashes(c.data, w.start, w.end)]), w.row


@dataclass
class Model:
    """Sorted feature hashes with the log-odds that a word has whose most specific known feature it is."""

    hashes: np.ndarray
    log_odds: np.ndarray
    lam: float
    k: float
    slope: float
    intercept: float

    BITS = 22

    def prepare(self) -> None:
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[self.hashes >> np.uint64(64 - self.BITS)] = True

    def token_scores(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of tokens with a log-odds other than 0, those log-odds); every use counts."""
        if not len(self.hashes) or not levels.shape[1]:
            return np.zeros(0, np.int64), np.zeros(0)
        if not hasattr(self, "maybe"):
            self.prepare()
        feature = np.full(levels.shape[1], -1, dtype=np.int64)
        for level in levels:  # the more specific overwrite the others
            i = np.flatnonzero(self.maybe[level >> np.uint64(64 - self.BITS)])
            j = np.minimum(np.searchsorted(self.hashes, level[i]), len(self.hashes) - 1)
            hit = self.hashes[j] == level[i]
            feature[i[hit]] = j[hit]
        at = np.flatnonzero(feature >= 0)
        return at, self.log_odds[feature[at]]

    def score(self, significance: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + self.slope * significance)))


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in order, in time linear in the scores.

    Words that ``at`` doesn't list have the score ``-drift``. Ties go to the shorter, earlier segment.
    """
    out: list[list] = []  # first, last, sum before it, sum up to its end
    total, last = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (p - last - 1)
        last, s = p, s - drift
        if s <= 0:
            total += s
            continue
        new = [p, p, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in out]


def significance(found: list[tuple[int, int, float]], n_words: int, lam: float, k: float) -> float:
    """-ln of the chance of the best first-r sum of segment scores in a text of this length; 0 without any."""
    if not found:
        return 0.0
    base, best, total, log_fact = math.log(max(k * max(n_words, 1), 1e-9)), 0.0, 0.0, 0.0
    for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
        total += lam * s - base
        log_fact += math.log(r) + (math.log(r - 1) if r > 1 else 0.0)
        t = max(total, 1e-9)
        best = max(best, t - (r - 1) * math.log(t) + log_fact if r > 1 and t > r else t if r == 1 else 0.0)
    return min(best, CAP)


def _counted(rows: DataFrame) -> DataFrame:
    """hash, parent, toxic, clean: sampled documents of each class that have a feature; uses: how often clean ones have it."""

    @freeing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for c in B.chunks(b.column(0)):
                levels, row = features(c)
                of = np.repeat(np.arange(c.lo, c.hi), np.diff(row))
                parent = np.zeros_like(levels)
                for k in range(1, len(levels)):
                    parent[k] = np.where(levels[k - 1] != 0, levels[k - 1], parent[k - 1])
                h, p, d = levels.ravel(), parent.ravel(), np.tile(of, len(levels))
                some = h != 0
                h, p, d = h[some], p[some], d[some]
                order = np.lexsort((d, h))
                h, p, d = h[order], p[order], d[order]
                every, begin = 1 - toxic[d], np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else []
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, p, y = h[first], p[first], toxic[d[first]]
                if not len(h):
                    continue
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                t = np.add.reduceat(y, start)
                n = np.diff(np.append(start, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(h[start])), pa.array(B.signed(p[start])), pa.array(t), pa.array(n - t), pa.array(np.add.reduceat(every, begin))], ["hash", "parent", "toxic", "clean", "uses"])

    out = rows.select("text", F.col("toxic").cast("long")).mapInArrow(count, "hash long, parent long, toxic long, clean long, uses long")
    return out.groupBy("hash").agg(F.max("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("uses").alias("uses"))


def _log_odds(hashes: np.ndarray, parent: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of each feature under a Dirichlet prior with the parent's odds as mean; features sorted by hash."""
    i = np.minimum(np.searchsorted(hashes, parent), max(len(hashes) - 1, 0))
    known = hashes[i] == parent if len(hashes) else np.zeros(0, bool)
    up = np.where(known, i, -1)
    t, c = toxic * (n_toxic + n_clean) / (2 * n_toxic), clean * (n_toxic + n_clean) / (2 * n_clean)
    odds = np.ones(len(hashes))
    for _ in range(len(PREFIXES) + 1):  # from the shortest prefix to the word
        odds = (t + PRIOR * np.where(up >= 0, odds[up], 1.0)) / (c + PRIOR)
    return np.log(odds)


def _lambda(positive: np.ndarray, weight: np.ndarray, n_tokens: float, drift: float) -> float:
    """The root of sum p e^(lambda s) = 1 for scores of clean tokens."""
    p = weight / n_tokens
    rest = 1.0 - p.sum()
    f = lambda x: float((p * np.exp(x * (positive - drift))).sum() + rest * math.exp(-x * drift)) - 1.0
    lo, hi = 1e-4, 1e-4
    while f(hi) < 0 and hi < 20:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method."""
    w, a = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _scan(rows: DataFrame, shared, columns: list[str], schema: str, make) -> DataFrame:
    """A map over texts; ``make(model, batch, lo, hi, found segments, words)`` gives the arrays of each chunk."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for c in B.chunks(b.column(0)):
                levels, row = features(c)
                at, s = model.token_scores(levels)
                cut = np.searchsorted(at, row)
                found = [segments(at[i:j] - w, s[i:j]) if j > i else [] for i, j, w in zip(cut[:-1], cut[1:], row[:-1], strict=True)]
                yield make(model, b, c.lo, c.hi, found, np.diff(row))

    return modest_batches(rows).select(*columns).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id") -> Model:
    """A model from labelled documents outside fold 0: folds 1 to 3 give the counts, fold 4 the calibration.

    Where either of these has labels of one class only, all four folds give both;
    where all labels are of one class, the score is the share of toxic labels,
    but under 0.5: what can't be told apart isn't rejected.
    """
    marked = labels.where(fold(key) > 0).where(F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    # At most 4 * per_class ids: a bounded table, so that whole texts needn't be shuffled to meet their labels.
    sample = written(docs.select(key, "text").join(F.broadcast(bounded(marked, "toxic", per_class, key)), key).withColumn("fold", fold(key)), "toxic-sample")
    sizes = {(r["toxic"], r["calibrate"]): r["n"] for r in sample.groupBy("toxic", (F.col("fold") == 4).alias("calibrate")).agg(F.count("*").alias("n")).collect()}
    parted = all(sizes.get((t, c), 0) for t in (0, 1) for c in (False, True))
    n_toxic, n_clean = (sizes.get((t, False), 0) + (0 if parted else sizes.get((t, True), 0)) for t in (1, 0))
    empty = np.zeros(0, np.uint64)
    if not n_toxic or not n_clean:
        share = min(max(n_toxic / max(n_toxic + n_clean, 1), 1e-3), 0.499)
        return Model(empty, np.zeros(0), 1.0, 1.0, 0.0, math.log(share / (1 - share)))
    counts = _counted(sample.where("fold < 4") if parted else sample)
    # Features that stand out, and the prefixes they lean on.
    t, c = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    z = F.abs(F.log((t + 0.5 / n_toxic) / (c + 0.5 / n_clean))) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = counts.where(F.col("toxic") + F.col("clean") >= MIN_COUNT).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "hash").limit(MAX_FEATURES).toPandas()
    h = top["hash"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, top = h[order], top.iloc[order]
    clean, uses = top["clean"].to_numpy(float), top["uses"].to_numpy(float)
    odds = _log_odds(h, top["parent"].to_numpy().astype(np.int64).view(np.uint64), top["toxic"].to_numpy(float), clean, n_toxic, n_clean)
    use = np.abs(odds) >= MIN_LOG_ODDS
    h, odds, uses = h[use], odds[use], uses[use]
    positive = odds > DRIFT
    model = Model(h, odds, 1.0, 1.0, 1.0, 0.0)
    spark = docs.sparkSession

    def texts(model, b, lo, hi, found, n):
        best = [max((x[2] for x in f), default=0.0) for f in found]
        return pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array([[x[2] for x in f] for f in found], pa.list_(pa.float64())), pa.array(best)], ["toxic", "n", "found", "best"])

    calibration = _scan(sample.where("fold = 4") if parted else sample, spark.sparkContext.broadcast(model), ["text", "toxic"], f"toxic {sample.schema['toxic'].dataType.simpleString()}, n long, found array<double>, best double", texts).toPandas()
    y = calibration["toxic"].to_numpy(float)
    n, best = calibration["n"].to_numpy(float), calibration["best"].to_numpy(float)
    quiet = y == 0
    tokens = max(n[quiet].sum() * n_clean / max(quiet.sum(), 1), 1.0)
    model.lam = min(_lambda(odds[positive], uses[positive], tokens, DRIFT), 2.0) if positive.any() else 1.0
    level = float(np.median(odds[positive])) if positive.any() else 1.0
    model.k = max(float((best[quiet] >= level).sum()) * math.exp(model.lam * level) / max(n[quiet].sum(), 1.0), 1e-6)
    x = np.array([significance([(0, 0, s) for s in f], int(m), model.lam, model.k) for f, m in zip(calibration["found"], n, strict=True)])
    model.slope, model.intercept = logistic(x, y)
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", passages: bool = True) -> DataFrame:
    """key, score, predicted, significance, n_passages and, where asked for, the passages: first and last word and score of each significant segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, score double, predicted int, significance double, n_passages int" + ", passages array<struct<first:int,last:int,score:double>>" * passages

    def make(model, b, lo, hi, found, n):
        x = np.array([significance(f, int(m), model.lam, model.k) for f, m in zip(found, n, strict=True)])
        p = model.score(x)
        real = [[s for s in f if model.lam * s[2] > math.log(max(model.k * m, 1e-9))] for f, m in zip(found, n, strict=True)]
        out = [b.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x), pa.array([len(f) for f in real], pa.int32())]
        if passages:
            kind = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])
            out.append(pa.array([[{"first": a, "last": z, "score": s} for a, z, s in f] for f in real], pa.list_(kind)))
        return pa.RecordBatch.from_arrays(out, [key, "score", "predicted", "significance", "n_passages"] + ["passages"] * passages)

    return _scan(docs, shared, ["text", key], schema, make)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["text", *[c for c in docs.columns if c != "text"]]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def make(model, b, lo, hi, found, n):
        x = np.array([significance(f, int(m), model.lam, model.k) for f, m in zip(found, n, strict=True)])
        return b.slice(lo, hi - lo).filter(pa.array(model.score(x) < 0.5))

    return _scan(docs, shared, names, schema, make).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model, passages=False).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", "n_passages")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
