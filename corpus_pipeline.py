"""A corpus pipeline over ``documents``: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder, gives it to the next stage and
deletes it when that is written. All but the last return the columns of
``documents``.

Defined results: documents without text or letters go at the second stage, as
their language can't be told; of rows that repeat an id and a text one stays,
rows that share an id but not a text are told apart; ties among near duplicates
go to the least id; rows without an id are neither near duplicates nor give or
lose passages; an empty table gives an empty result, without labels nothing is
toxic; extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit_packing, jaccard_join, language_id, substring_dedup, toxicity
from tessera.llm.shared import dropped, read_table, unused, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model fitted on the labelled ones among them."""
    return toxicity.clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language can be told of: text without a letter goes."""
    return language_id.identified(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return jaccard_join.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; what has no word left goes."""
    out = substring_dedup.deduplicated(docs, removed=unused(docs, "n_removed"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with the sequence and the offset of each."""
    return best_fit_packing.pack(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("language_id", with_language),
    ("jaccard_join", one_of_each),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]

#: Models and tokenizers aren't SQL; tests/llm holds ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    dropped(docs)  # the last stage has written its pieces
    return out
