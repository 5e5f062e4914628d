"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` adds length, symbol, stop-word and line measures of each text with
built-in expressions only; ``verdict`` turns a table of thresholds into one
boolean column per rule and their conjunction. There is no shuffle: every
column of a row follows from that row alone, so a hot source or a group of
copies costs what its rows cost.

Defined results: a null text counts as empty; an empty text has zero words,
fails the base rule and every ratio of it is 0. Repeated rows each get their own
row. Extra columns pass through ``measures`` and ``apply`` unchanged unless their
names are those of the added columns, which then replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, unused

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be at this by from or an have not but which "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus "
    "le la les de des et un une du est que dans qui pour pas au sur par plus ce se "
    "el los las y en del una por con no para su al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep where ``low <= measure <= high``; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are of words unless the name says otherwise.
RULES = (
    Rule("length", "n_words", low=MIN_WORDS),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("repeats", "repeat_ratio", high=0.5),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words and the ratios."""
    # A caller's columns with the names of this function's own step aside until the end.
    aside = {c: unused(docs, f"{c}_aside") for c in docs.columns if c.lower() in ("_t", "_w", "_lines", "_grams", "_sorted")}
    d = docs.withColumnsRenamed(aside)
    d = d.withColumn("_t", F.coalesce(F.col(aside.get(text, text)), F.lit("")))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "_lines": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)),
            "_grams": F.when(
                F.size("_w") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
            ),
        }
    )
    # Windows sorted with their places; only texts in which some window comes twice.
    d = d.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ),
    )
    same = lambda a, b: F.coalesce(F.get("_sorted", a)["g"] == F.get("_sorted", b)["g"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    places = F.transform(twice, lambda k: F.get("_sorted", k)["i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))
    d = d.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_sorted").isNotNull(), covered).otherwise(0).cast("long"),
            "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        }
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    d = d.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "stop_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
        }
    )
    return d.drop("_t", "_w", "_lines", "_grams", "_sorted").withColumnsRenamed({v: k for k, v in aside.items()})


def verdict(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """The table as columns: ``pass_<rule>`` for each rule and ``passed`` for all of them."""
    out = {}
    for r in rules:
        tests = [F.col(r.measure) >= r.low] * (r.low is not None) + [F.col(r.measure) <= r.high] * (r.high is not None)
        test = F.lit(True)
        for t in tests:
            test = test & t
        out[f"pass_{r.name}"] = test
    every = F.lit(True)
    for c in out.values():
        every = every & c
    return out | {"passed": every}


def apply(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All rows with their measures, the verdict of each rule, and ``passed``."""
    return measures(docs, text).withColumns(verdict(rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    return apply(docs, rules, text).where("passed").select(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = apply(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("passed")).alias("kept"))


def _sql() -> str:
    def test(r: Rule) -> str:
        return " AND ".join([f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None))

    word = WORD.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN n USING (doc_id)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
             (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(test(r) for r in RULES)}) AS kept FROM q
"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL = {"op10_quality_rules": _sql()}
