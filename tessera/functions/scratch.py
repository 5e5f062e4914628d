"""The folder that all executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a row of a few numbers takes in a broadcast, against those in a Parquet file: sorted ids take 4 there, and a hashed row about 110.
IN_MEMORY = 32


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def sized(spark: SparkSession) -> Iterator[None]:
    """What is planned inside takes files for ``IN_MEMORY`` times their size, so that the size limit of broadcasts holds for what the driver gets."""
    with _set(spark, "spark.sql.sources.fileCompressionFactor", str(IN_MEMORY)):
        yield


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a written table: later reads don't repeat its work and survive lost executors. Its shuffle files go when it is written."""
    return appended(df, table_path(df.sparkSession, name))


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def appended(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, which needn't be there yet, with the rows of ``df``."""
    spark = df.sparkSession
    with sized(spark), _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` made and that nothing will read again; other frames are left alone."""
    for df in tables:
        spark = df.sparkSession
        top = shared_dir(spark).split(":", 1)[-1].lstrip("/")
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if at.rsplit("/", 1)[-1].startswith("tessera-") and top in at:
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def instead(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a written table in place of those of ``kept`` that it reads, which go."""
    out = kept(df, name)
    dropped(df)
    return out
