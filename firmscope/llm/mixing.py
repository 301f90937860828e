"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a shuffled queue. A copy's *virtual finish time*
is the words its source has sent by then, divided by the source's weight. All
copies are put in the order of finish times and the list is cut where the total
budget is used up; a source whose copies are used up leaves the queue, so that
the others share what it leaves by weight.

No order is ever computed in one task: every prefix sum is taken in two levels,
over evenly filled buckets of the sort key and then within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import textkernel as tk
from firmscope.llm.shared import need, saved

#: Rows that a bucket of a two-level prefix sum holds on average.
BUCKET_ROWS = 8192
#: Times a source may be repeated at most.
MAX_REPEATS = 3
_UNIT = float(1 << 60)


def count_words(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size): words ``[^\\x20\\x09-\\x0D]+`` of every whole text; null counts 0."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("source", T.StringType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [np.zeros(0, np.int64)]
            sizes += [tk.words(data, offsets).n_words for _, _, data, offsets in tk.chunks(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(sizes), pa.int64())], ["id", "source", "size"])

    return need(docs, id_col, source_col, text_col).mapInArrow(run, schema)


def targets(sources: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Add rank, weight, target and level to one row a source (source, source_size).

    The windows see one row a source, never the documents. Targets are the fixed
    point of "share by weight, stop at the cap, reshare the excess": sources in
    the order of cap / weight are capped as long as the level that the others
    would get is not below theirs.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(order))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("n_all", F.sum("n_docs").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
        .withColumn("own_level", (F.col("budget") - F.col("caps_before")).cast("double") / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("capped", F.col("cap").cast("double") / F.col("weight") <= F.col("own_level"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap").cast("double") / F.col("weight"), "rank", "own_level"))).over(everything)["own_level"])
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return filled.select("source", "source_size", "n_docs", "rank", "weight", target.alias("target"), "level", "budget", "n_all")


def _prefix(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of value by keys, in the order of (bucket, order)."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum(value).over(inner)).join(sums, [*keys, bucket]).withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = MAX_REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """One row a document: id, size, source_size, target, taken, copies.

    Sources by code point, null last, have the weights in turn and share all
    sizes. ``taken`` counts repeats; it is 0 for a document past the cut and at
    most ``max_repeats`` times its size. The shuffle is the MD5 of seed and id,
    so reruns agree; rows with the same id and size are interchangeable. Ids should
    tell rows apart: rows that share one are queued in one task. Sources are few:
    their table, one row each, is handled in one task.
    Null ids hash as empty text, an empty table gives no rows, null or empty
    texts have size 0 and take 0.
    """
    sized = saved(count_words(docs, id_col, text_col, source_col), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, max_repeats)
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    s = sources.withColumnRenamed("source", "_source")
    rows = sized.join(s, sized["source"].eqNullSafe(s["_source"])).drop("_source").withColumn("u", key)
    rows = rows.withColumn("slot", F.floor(F.col("u") / F.lit(_UNIT) * F.ceil(F.col("n_docs") / F.lit(float(BUCKET_ROWS)))))
    order = ["u", "id", "size"]
    rows = _prefix(rows, ["rank"], "slot", order, "size", "cum")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("rank", "slot").orderBy(*order)))
    # A source without words never queues: its documents have nothing to send.
    copies = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_repeats)])))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("cum")).cast("double") / F.col("weight"))
    n = F.ceil(F.col("n_all") / F.lit(float(BUCKET_ROWS)))
    # Without any words every order will do.
    slice_ = F.when(F.col("level") > 0, F.floor(F.col("finish") / F.col("level") * n)).otherwise(F.pmod("u", F.greatest(n, F.lit(1))))
    copies = copies.withColumn("slice", slice_.cast("long")).select("id", "size", "source_size", "target", "rank", "slot", "place", "epoch", "finish", "slice", "budget", "u")
    queued = _prefix(copies, [], "slice", ["finish", "rank", "epoch", "u", "id", "size"], "size", "sent")
    sent = F.when(F.col("sent") <= F.col("budget"), 1).otherwise(0)
    out = queued.groupBy("rank", "slot", "place", "id", "size", "source_size", "target").agg(F.sum(sent).cast("int").alias("copies"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
