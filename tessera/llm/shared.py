"""Where jobs keep intermediate tables: the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset (local tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage is cut and any executor can read it."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing will read again; other frames are left alone."""
    for df in tables:
        spark = df.sparkSession
        top = shared_dir(spark).split(":", 1)[-1].lstrip("/")
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if at.rsplit("/", 1)[-1].startswith("tessera-") and top in at:
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that isn't a column of ``docs``: for columns of an operator's own."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def freeing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The generator function of a task, giving freed memory back to the system at its end: Python workers live on."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return run


@contextmanager
def rows_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most ``n`` rows for what is run inside: for rows of many kilobytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession, last: bool = False) -> None:
    """Let Spark delete the shuffle files of finished steps now; else they stay until the driver's garbage is collected.

    What has just ended may still be on its way to Spark's listeners; with ``last`` it is waited for.
    """
    for wait in (0, 1) if last else (0,):
        time.sleep(wait)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: Rows of whole texts that an Arrow batch holds at most; Spark's own default of 10,000 is tens of megabytes a batch.
TEXT_ROWS = 1000


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches brought down to ``TEXT_ROWS`` rows: it counts when a plan runs, so it stays set."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df
