"""Importance resampling of documents towards a target's distribution of hashed words.

Equal texts are collapsed by grouping on the whole text (with partial sums, so
a text that a third of all rows hold costs one row for each map task). Each
different text is cut into words and hashed once; its buckets are kept in a
narrow table. The corpus counts are the texts' counts times their copies, the
gain of a bucket compares them with the target's, and each text's weight is
worked out once. Documents then get their text's weight back through the
text's SHA-256 digest, and only then their own noise.

The draw needs global ranks without one sorted task: scores are whole numbers
of a bounded range (logarithms in thousandths), so their histogram is a bounded
table whose running sum says where each score's ranks begin; ties are ranked
within their score.

Defined results: a null text is an empty one, with no features, weight 0 and
noise of its own; a null id gets the noise of an empty id and comes first among
ties; repeated rows are drawn one by one; an empty table gives an empty result,
an empty target counts of zero; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import dropped, read_table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _runs(words: Column, run: int) -> Column:
    """All runs of 1 to ``run`` consecutive words, joined by one space."""

    def of(n: int) -> Column:
        last = F.size(words) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *[of(n) for n in range(2, run + 1)])


def _buckets(words: Column, run: int, buckets: int) -> Column:
    return F.transform(_runs(words, run), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))


def features(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """One row for each different text: its digest ``text_id``, ``copies``, ``n_words`` and the bucket of each feature."""
    whole = docs.select(F.coalesce(text, F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    whole = whole.select(_text_id("text"), "copies", _words(F.col("text")).alias("w"))
    return whole.select("text_id", "copies", F.size("w").alias("n_words"), _buckets(F.col("w"), run, buckets).alias("buckets"))


def _text_id(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("text_id")


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Occurrences in each bucket, copies counted: at most ``buckets`` rows come to the driver."""
    out = [0] * buckets
    for r in feats.select("copies", F.explode("buckets").alias("b")).groupBy("b").agg(F.sum("copies").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Of each bucket, the thousandths of the log ratio of its smoothed shares, rounded down."""
    s_all, t_all = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source, target, strict=True)]


def weights(feats: DataFrame, gain: list[int]) -> DataFrame:
    """text_id, n_words, n_features and weight: the floored mean of the gains of a text's features."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal of len(gain) numbers
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    d = feats.select("text_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))
    return d.select("text_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def noise(key: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the digest of the seed and the document's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """``scored`` (key, score, eligible and more) with the ranks of the drawn rows: the highest scores, ties to the smaller key."""
    n = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n"))
    # One row for each whole score: at most 160,000 whatever the input, as gains and noise are logarithms in thousandths.
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = n.select("score", above.alias("above"), F.expr(f"{percent} * sum(n) OVER () div 100").alias("wanted"))
    d = scored.join(start, "score", "left")
    first = F.coalesce(F.col("eligible") & (F.col("above") < F.col("wanted")), F.lit(False))
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first(key)))
    top = d.where(first).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")))
    return top.unionByName(d.where(~first).withColumn("rank", F.lit(None).cast("long"))).drop("above", "wanted")


def resampled(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS, key: str = "doc_id") -> DataFrame:
    """key, n_features, weight, score and rank (null: not drawn) of every document."""
    feats = written(features(docs, run, buckets), "resampling-features")
    gain = gains(bucket_counts(feats, buckets), bucket_counts(features(target, run, buckets), buckets))
    d = docs.select(key, _text_id("text")).join(weights(feats, gain), "text_id")
    d = d.select(key, "n_features", "weight", (F.col("weight") + noise(key, seed)).alias("score"), (F.col("n_words") >= min_words).alias("eligible"))
    scored = written(d, "resampling-scores")
    dropped(feats)
    return drawn(scored, percent, key).select(key, "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("text"))


def _sql() -> str:
    words = lambda table: f"regexp_extract_all(translate(coalesce({table}.text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return rf"""
WITH dw AS (SELECT doc_id, {words("documents")} AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM dw),
b AS (SELECT unnest({words("benchmark")}) AS x FROM benchmark),
u AS (SELECT x FROM f UNION SELECT x FROM b),
-- CRC-32 by its polynomial, bit by bit, once for each different word
raw AS (SELECT x, list_transform(range(1, octet_length(encode(x)) + 1), lambda i: ('0x' || hex(encode(x))[2 * i - 1:2 * i])::BIGINT) AS bytes FROM u),
h AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y:
          list_reduce(list_prepend(xor(c, y), range(8)), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)), 4294967295) % {BUCKETS} AS k FROM raw),
s AS (SELECT k, count(*) AS s FROM f JOIN h USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN h USING (x) GROUP BY k),
g AS (SELECT r.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})::DOUBLE
                 / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM (SELECT unnest(range({BUCKETS})) AS k) r LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN h USING (x) JOIN g USING (k) GROUP BY doc_id),
w AS (SELECT dw.doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
             ('0x' || sha256('{SEED}:' || dw.doc_id)[1:8])::BIGINT AS h FROM dw LEFT JOIN m USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= {MIN_WORDS})
SELECT c.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END::BIGINT AS rank
FROM c LEFT JOIN r USING (doc_id)
"""


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLE_SQL = {"op12_importance_resampling": _sql()}
