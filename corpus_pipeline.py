"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns the columns of ``documents`` (the last one adds ``copies``, the times
a document is in the mix). Between stages the rows are a Parquet table in the
shared folder. Rows are told apart by a hash of id and text, so that repeated
ids don't mix up; rows that agree in both are one document from the mix on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.llm import decontaminate, jaccard_join, mixing, quality_rules, substring_dedup
from firmscope.llm.shared import new_path, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_ROW = "_row"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias(_ROW))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    keyed = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    marks = keyed.select("doc_id", _ROW).join(labels, "doc_id").select(_ROW, "quality")
    verdict = quality_rules.apply_rules(keyed, marks, id_col=_ROW)
    return keyed.join(verdict.where(~F.col("kept")).select(_ROW).distinct(), _ROW, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents that with the smallest id stays (one without
    id only where none has one); documents without words are groups of their own."""
    classes = jaccard_join.similarity_classes(docs.select(*COLUMNS))
    first = classes.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    stays = first.select(F.col("first.key").alias(_ROW)).union(classes.where("root is null").select("key"))
    return _keyed(docs).join(stays, _ROW, "left_semi").dropDuplicates([_ROW]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; documents left without words go."""
    cut = substring_dedup.dedup_substrings(docs, keep_key=True).where("n_removed > 0")
    changed = cut.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "kept").dropDuplicates(["_id", "_key"])
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(*COLUMNS).withColumn("_k", key).join(changed, (F.col("doc_id") == F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    rows = rows.where(F.col("kept").isNull() | (F.col("kept") != ""))
    text = F.coalesce("kept", "text")
    n_chars = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("kept").cast("long"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; ``copies`` says how often a document is in."""
    keyed = _keyed(docs)
    mixed = mixing.mix(keyed, id_col=_ROW).groupBy(_ROW).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    return keyed.dropDuplicates([_ROW]).join(mixed, _ROW).select(*COLUMNS, "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", source_mix),
]

#: Trained trees are part of the first stage, which SQL cannot express; tests hold
#: every stage against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
