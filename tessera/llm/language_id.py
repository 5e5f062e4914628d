"""Hierarchical language identification: family first, then the languages within it.

A text is a vector of hashed letter bigrams and trigrams (square roots of
counts, unit length). One-versus-one linear support vector machines tell
language families apart, others tell the languages of one family apart; each
decides by votes, ties by summed margins. A margin becomes a probability by a
logistic curve; the score is the product of the two winners' weakest ones.

Fitting takes at most about ``PER_LANGUAGE`` labelled texts a language (a
documented bound), whose vectors of ``DIMENSIONS`` numbers go to the driver.
Prediction is a map over whole texts: no shuffle, memory bounded by a chunk.

Defined results: null texts and texts without a letter are ``und`` with score 0;
with one language learned, that one; with none, ``und``. Repeated rows each get
their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewise as B
from .sampling import bounded, fold
from .shared import freeing, modest_batches, read_table, unused

PER_LANGUAGE = 600
DIMENSIONS = 4096
#: Texts whose vectors are held at once.
MAX_ROWS = 256
UNDETERMINED = "und"
#: Families of languages by code; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "indo-iranian": "hi ur bn pa mr gu ne fa ps ku",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv mg",
    "dravidian": "ta te kn ml",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_IS_ASCII_LETTER = np.zeros(256, dtype=bool)
_IS_ASCII_LETTER[65:91] = _IS_ASCII_LETTER[97:123] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[32] = True


def vectors(chunk: B.Chunk, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each text: square roots of hashed bigram and trigram counts, unit length (zero without letters).

    Marks and digits count as spaces, runs of spaces as one; a text begins and ends with one.
    """
    n_texts = chunk.hi - chunk.lo
    d = _LETTERS[chunk.data]
    gap = d == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first space after a letter stays
    at = np.concatenate([[0], np.cumsum(keep)])[chunk.offsets]
    d = d[keep]
    of = np.repeat(np.arange(n_texts), np.diff(at))
    # A space at each text's start, so that words at both ends look alike.
    d = np.insert(d, at[:-1], 32).astype(np.int64)
    of = np.insert(of, at[:-1], np.arange(n_texts))
    out = np.zeros((n_texts, dimensions), dtype=np.float32)
    for size, salt in ((2, 0x9E37), (3, 0x85EB)):
        if len(d) < size:
            continue
        h = np.full(len(d) - size + 1, salt, dtype=np.int64)
        for k in range(size):
            h = h * 0x01000193 + d[k : len(d) - size + 1 + k]
        h = (h ^ (h >> 15)) * 0x2C1B3C6D
        h = (h >> 12) % dimensions
        same = of[: len(h)] == of[size - 1 :]
        out += np.bincount(of[: len(h)][same] * dimensions + h[same], minlength=n_texts * dimensions).reshape(n_texts, dimensions)
    out = np.sqrt(out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def has_letter(chunk: B.Chunk, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any alphabet."""
    total = np.concatenate([[0], np.cumsum(_IS_ASCII_LETTER[chunk.data])])[chunk.offsets]
    out = np.diff(total) > 0
    for i in np.flatnonzero(~out & (np.diff(chunk.offsets) > 0)):
        out[i] = any(map(str.isalpha, texts[chunk.lo + int(i)].as_py() or ""))
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted alike, by Nesterov's method."""
    a = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype) * x.dtype.type(2 * c)
    step = x.dtype.type(1.0 / (1.0 + 2 * c * 2.0))  # rows have length sqrt(2)
    w = v = np.zeros(a.shape[1], dtype=x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (a @ v))
        new = v - step * (v - a.T @ (2 * weight * y * slack))
        v = new + x.dtype.type(k / (k + 3.0)) * (new - w)
        w = new
    return w


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The factor that makes the logistic curve of margins likeliest."""
    a, m = 1.0, margin * y
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(a * m, -30, 30)))
        g, h = (m * p).sum() - 0.01 * a, -(m * m * p * (1 - p)).sum() - 0.01
        a = min(max(a - g / h, 0.1), 20.0)
    return a


@dataclass
class Machines:
    """One-versus-one machines over some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    slopes: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray) -> Machines:
        m = cls(sorted(set(label.tolist())))
        weights, slopes = [], []
        for i, j in combinations(range(len(m.classes)), 2):
            rows = (label == m.classes[i]) | (label == m.classes[j])
            y = np.where(label[rows] == m.classes[i], 1.0, -1.0)
            w = svm(x[rows], y)
            m.pairs.append((i, j))
            weights.append(w)
            slopes.append(slope(x[rows] @ w[:-1] + w[-1], y))
        if weights:
            m.weights, m.slopes = np.array(weights), np.array(slopes)
        return m

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winning class, the least probability of its wins) for each row."""
        n = len(self.classes)
        if not self.pairs:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margin = (x @ self.weights[:, :-1].T + self.weights[:, -1]) * self.slopes
        votes, total, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margin[:, k]), (j, -margin[:, k])):
                votes[:, c] += m > 0
                total[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        best = votes == votes.max(axis=1, keepdims=True)
        win = np.where(best, total, -np.inf).argmax(axis=1)
        return win, 1 / (1 + np.exp(-np.clip(least[np.arange(len(x)), win], -30, 30)))


@dataclass
class Model:
    families: Machines
    within: dict[str, Machines]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each vector."""
        out, score = np.full(len(x), UNDETERMINED, dtype=object), np.zeros(len(x))
        if not self.families.classes:
            return out, score
        f, p = self.families.predict(x)
        for i, name in enumerate(self.families.classes):
            rows = np.flatnonzero(f == i)
            if len(rows):
                m = self.within[name]
                k, q = m.predict(x[rows])
                out[rows], score[rows] = np.array(m.classes, dtype=object)[k], p[rows] * q
        return out, score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id") -> Model:
    """A model from texts with a language outside fold 0."""
    rows = docs.select(key, "text", "lang").where(fold(key) > 0).where(F.col("lang").isNotNull() & (F.col("text").rlike(r"\p{L}")))
    sample = bounded(rows, "lang", per_language, key)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in B.chunks(b.column(0), rows=MAX_ROWS):
                x = vectors(c)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(c.lo, c.hi - c.lo), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["lang", "v"])

    got = modest_batches(sample).select("text", "lang").mapInArrow(run, "lang string, v binary").toPandas()
    if not len(got):
        return Model(Machines([]), {})
    x = np.stack([np.frombuffer(v, dtype=np.float16) for v in got["v"]]).astype(np.float32)
    lang = got["lang"].to_numpy(dtype=object)
    family = np.array([FAMILY.get(v, v) for v in lang], dtype=object)
    return Model(Machines.fit(x, family), {f: Machines.fit(x[family == f], lang[family == f]) for f in sorted(set(family))})


def predicted(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["text", *[c for c in docs.columns if c not in ("text", pred, score)]]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{pred}` string, `{score}` double"

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for c in B.chunks(b.column(0), rows=MAX_ROWS):
                lang, p = model.predict(vectors(c))
                some = has_letter(c, b.column(0))
                lang, p = np.where(some, lang, UNDETERMINED), np.where(some, p, 0.0)
                yield pa.RecordBatch.from_arrays([*b.slice(c.lo, c.hi - c.lo).columns, pa.array(lang.tolist(), pa.string()), pa.array(p)], [*names, pred, score])

    out = modest_batches(docs).select(*names).mapInArrow(run, schema)
    return out.select(*[c for c in docs.columns if c not in (pred, score)], pred, score)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that have a language, with its columns: texts without a letter, which no language fits, go."""
    pred, score = unused(docs, "_pred"), unused(docs, "_score")
    return predicted(docs, model, pred, score).where(F.col(pred) != UNDETERMINED).select(*docs.columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs)
    return predicted(docs.select("doc_id", "text"), model, score="score").select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
