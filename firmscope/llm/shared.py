"""Folder that the driver and all executors share, and small plan helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.tables import new_path, shared_dir  # noqa: F401

#: Bytes that a batch between the JVM and Python holds at most while a table is saved.
BATCH_BYTES = 16 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller batches to Python for what runs inside, unless the session has its own
    size: texts stand in the memory of both sides, several times over."""
    own = spark.conf.get(_BATCH, _BATCH_DEFAULT) != _BATCH_DEFAULT
    if not own:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not own:
            spark.conf.set(_BATCH, _BATCH_DEFAULT)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, so that a lost
    executor costs a re-read, and fixes the rows where a plan uses them twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_by_size(df: DataFrame, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of input by the optimizer's estimate (file
    sizes for files), 16 a shuffle partition at most; 4 where it has no estimate."""
    size, n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), n_parts(df.sparkSession)
    return 4 * n if size >= 1 << 60 else max(1, min(-(-size // block_bytes), 16 * n))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns; what else the caller's table holds never travels."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def row_key(ident: Column, text: Column) -> Column:
    """A hash of id and text that tells rows apart whose ids don't."""
    return F.xxhash64(F.coalesce(ident.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))
