"""Order-dependent scans: budgets, overlaps, extents, range joins, hash trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.tables import saved


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """Running total of ``value`` by keys in an order, including the row.

    In two levels, so that a key of any size is many tasks' work: rows are dealt by
    ranges of (keys, order), summed in their range, and each range starts from the
    sums of the key's ranges before it. The dealt rows go to the shared folder, as
    both levels must see the same ranges.
    """
    dealt = saved(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    total = dealt.withColumn("_inner", F.sum(value).over(inner)).join(sums, same)
    return total.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_inner")).alias(out))


def running_budget(df: DataFrame, keys: list[str], order: list[str | Column], size: str, limit: int, policy: str = "check-first") -> DataFrame:
    """Keep rows while a byte budget lasts, in order.

    ``check-first``: a row is taken as long as the budget isn't used up before it
    (the last one may overshoot). ``stop``: rows from the first one that doesn't
    fit are out. Adds ``used``, the running total including the row.
    """
    if policy not in ("check-first", "stop"):
        raise ValueError(f"unknown policy {policy}")
    used = running_sum(df, keys, order, size, "used")
    return used.where(F.col("used") - F.col(size) < limit) if policy == "check-first" else used.where(F.col("used") <= limit)


def skipping_budget(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Keep rows that still fit, skipping those that don't and going on.

    There is no prefix sum for this, so each key's rows pass one task in order; but
    as a stream, sorted by the shuffle, with one running total in memory.
    """
    rows = df.select(F.col(key), F.col(order), F.col(size).cast("bigint").alias(size))
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = object(), 0
        for b in batches:
            keep = []
            for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != at:
                    at, used = k, 0
                fits = n is not None and used + n <= limit
                used += n if fits else 0
                keep.append(fits)
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, fields)


def overlaps(df: DataFrame, keys: list[str], start: Column, end: Column, ties: list[str | Column]) -> DataFrame:
    """Rows whose range begins before their sorted neighbour ends. Says whether a key
    has any overlap; it isn't the set of all overlapping pairs."""
    w = Window.partitionBy(*keys).orderBy("range_start", "range_end", *ties)
    r = df.withColumn("range_start", start).withColumn("range_end", end)
    return r.withColumn("previous_end", F.lag("range_end").over(w)).where("previous_end > range_start")


def extent_offsets(df: DataFrame, keys: list[str], order: list[str | Column], length: str) -> DataFrame:
    """Where each extent begins when they are laid out one after the other."""
    return running_sum(df, keys, order, length, "_end").withColumn("begin", F.col("_end") - F.col(length)).drop("_end")


def index_range_join(owners: DataFrame, items: DataFrame, first: str, count: str, index: str, width: int = 1 << 16) -> DataFrame:
    """items whose index lies in an owner's [first, first + count).

    Both sides meet in buckets of ``width`` indexes: a range is opened to the buckets
    that it touches, never to its indexes, so the join is an equi-join on the bucket
    with the range as a condition, and a range of millions costs a few rows.
    """
    buckets = F.sequence(F.floor(F.col(first) / width), F.floor((F.col(first) + F.col(count) - 1) / width))
    opened = owners.where(F.col(count) > 0).withColumn("_bucket", F.explode(buckets))
    inside = items.withColumn("_bucket", F.floor(F.col(index) / width))
    return opened.join(inside, "_bucket").where((F.col(index) >= F.col(first)) & (F.col(index) < F.col(first) + F.col(count))).drop("_bucket")


def rank_below(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n): pairs of a left and a right row of one key with left value < right value.

    No pair is built: both sides become counts by value, and each right value takes
    the running count of the left values before it. left, right: key, value.
    """
    one = lambda df, c: df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias(c))
    both = one(left, "l").join(one(right, "r"), [key, value], "full").fillna(0, ["l", "r"])
    before = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    pairs = both.withColumn("n", F.col("r") * F.coalesce(F.sum("l").over(before), F.lit(0)))
    return pairs.groupBy(key).agg(F.sum("n").alias("n")).where("n > 0")


def block_entropy(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """Shannon entropy in bits per byte of each row's bytes; rows of equal keys are one.

    Bytes are counted where they are, in one pass; 256 counts a row travel.
    """
    fields = T.StructType([*[df.schema[k] for k in keys], T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256) for x in b.column(len(keys))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * 256), pa.array(np.concatenate([np.zeros(0, np.int64), *counts])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], lists], fields.names)

    counted = df.where(F.octet_length(data) > 0).select(*keys, data).mapInArrow(run, fields)
    summed = counted.groupBy(*keys).agg(*[F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(256)])
    n = F.filter(F.array(*[F.col(f"n{k}") for k in range(256)]), lambda x: x > 0)
    total = summed.select(*keys, F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("t"), F.aggregate(n, F.lit(0.0), lambda a, x: a + x * F.log2(x)).alias("s"))
    return total.select(*keys, (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


#: Data at least this long and this near to 8 bits a byte is compressed or encrypted.
ENTROPY_BYTES, ENTROPY_BITS = 4096, 7.9


def high_entropy(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """(keys, entropy) of data that looks compressed or encrypted."""
    long = df.where(F.octet_length(data) >= ENTROPY_BYTES)
    return block_entropy(long, keys, data).where(F.col("entropy") >= ENTROPY_BITS)


def hash_tree(blocks: DataFrame, salt: bytes, block_size: int = 4096) -> DataFrame:
    """Root of a SHA-256 tree over (index, data) blocks of equal size.

    Every level packs the digests of a level into blocks, pads the last with
    zeros and hashes them, until one block is left: log(n) group-bys, each of a
    128th of the rows before.
    """
    digest = lambda data: F.unhex(F.sha2(F.concat(F.lit(salt), data), 256))
    level = blocks.select("index", digest(F.col("data")).alias("digest"))
    seen = blocks.agg(F.count("*").alias("n"), F.min("index").alias("least"), F.max("index").alias("most"), F.sum("index").alias("sum")).first()
    n, fan = seen["n"], block_size // 32
    if n == 0:
        raise ValueError("no blocks")
    if (seen["least"], seen["most"], seen["sum"]) != (0, n - 1, n * (n - 1) // 2):
        raise ValueError("block indexes must be 0, 1, 2 and so on, without gaps")
    while True:
        group = level.groupBy(F.floor(F.col("index") / fan).alias("index")).agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("d"))
        joined = F.unhex(F.rpad(F.array_join(F.transform("d", lambda x: F.hex(x["digest"])), ""), 2 * block_size, "0"))
        level = group.select("index", digest(joined).alias("digest"))
        n = -(-n // fan)
        if n == 1:
            return level.select(F.lower(F.hex("digest")).alias("root"))
