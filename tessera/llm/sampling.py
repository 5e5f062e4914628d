"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo five; fold 0 is held out, as are rows without a key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS, F.lit(0))


def share(key: str = "doc_id", seed: int = 7) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def bounded(rows: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """About ``per_class`` rows of each label at most, by a threshold on a hash of the key.

    Only the counts of the labels come to the driver.
    """
    counts = {r[label]: r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    pick = F.lit(False)
    for value, n in sorted(counts.items()):
        pick = pick | ((F.col(label) == F.lit(value)) & (share(key) < min(1.0, per_class / n)))
    return rows.where(pick).limit(2 * per_class * max(1, len(counts)))
