"""Verified boot: states, digests of images, coverage, rollback of chained metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: algorithms that can be checked
ALGORITHMS = (1, 2, 3, 4, 5, 6)


def state_issues(vbmeta: DataFrame) -> DataFrame:
    """(image, rule, severity). vbmeta: image, flags, algorithm, is_footer."""
    bit = lambda k: F.col("flags").bitwiseAND(F.lit(1 << k)) != 0
    issue = lambda test, rule, level: F.when(test, F.struct(F.lit(rule).alias("rule"), level.alias("severity")))
    high = F.lit("high")
    issues = F.array(
        issue(bit(0), "avb-hashtree-disabled", high),
        issue(bit(1), "avb-verification-disabled", high),
        issue(bit(2), "avb-unknown-flag", high),
        issue(F.col("algorithm") == 0, "avb-unsigned", F.when(F.col("is_footer"), "info").otherwise("high")),
        issue((F.col("algorithm") != 0) & ~F.col("algorithm").isin(*ALGORITHMS), "avb-unsupported-algorithm", F.lit("low")),
    )
    return vbmeta.select("image", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select("image", "i.rule", "i.severity")


def image_digests(descriptors: DataFrame, images: DataFrame) -> DataFrame:
    """(partition, state): ok, mismatch, missing or unsupported, by a left join.
    descriptors: partition, algorithm, digest; images: name, sha256."""
    have = images.select(F.regexp_replace("name", r"\.img$", "").alias("partition"), "sha256")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("algorithm") != "sha256", "unsupported").when(F.col("digest") == F.col("sha256"), "ok").otherwise("mismatch")
    return descriptors.join(have, "partition", "left").select("partition", state.alias("state"))


def coverage(images: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(image, covered_by): the first descriptor that names the image.

    An image goes by its stem, and by its stem without a slot suffix; candidates
    are opened to rows, so the match is an equi-join, and the descriptor of lowest
    order wins. images: name; descriptors: ord, partition, kind.
    """
    stem = F.regexp_replace("name", r"\.img$", "")
    names = F.array_distinct(F.array(stem, F.regexp_replace(stem, "_[ab]$", "")))
    wanted = images.select(stem.alias("image"), F.explode(names).alias("partition"))
    first = Window.partitionBy("image").orderBy(F.col("ord").asc_nulls_last(), "partition")
    joined = wanted.join(descriptors.select("ord", "partition", "kind"), "partition", "left").withColumn("_n", F.row_number().over(first))
    return joined.where("_n = 1").select("image", F.col("kind").alias("covered_by"))


def rollback_regressions(top: DataFrame, chained: DataFrame) -> DataFrame:
    """Chained partitions whose own metadata is older than the top level demands.
    top, chained: partition, rollback_index."""
    t = top.select("partition", F.col("rollback_index").alias("wanted"))
    return chained.join(t, "partition").where(F.col("rollback_index") < F.col("wanted")).select("partition", "rollback_index", "wanted")


def certificate_concerns(certificates: DataFrame, now) -> DataFrame:
    """(path, concern). certificates: path, not_before, not_after, signature_algorithm, key_algorithm, key_bits."""
    say = lambda test, text: F.when(test, F.lit(text))
    weak = F.lower("signature_algorithm")
    concerns = F.array(
        say(F.col("not_after") < now, "expired"),
        say(F.col("not_before") > now, "not yet valid"),
        say(weak.contains("md5"), "signed with md5"),
        say(weak.contains("sha1"), "signed with sha1"),
        say((F.lower("key_algorithm") == "rsa") & (F.col("key_bits") < 2048), "short key"),
    )
    return certificates.select("path", F.explode(F.filter(concerns, lambda x: x.isNotNull())).alias("concern"))


def signature_outcomes(folders: DataFrame, vbmeta: DataFrame) -> DataFrame:
    """(dir, severity, outcome): what a folder's vbmeta.img says about its signature; a
    missing or unreadable one is told, not passed over. folders: dir; vbmeta: dir,
    signature (valid, invalid, absent, unsupported), algorithm, error."""
    s = F.col("signature")
    outcome = F.when(F.col("_met").isNull(), "no vbmeta.img found").when(F.col("error").isNotNull() | s.isNull(), "could not read vbmeta.img").when(s == "valid", "verified").when(s == "invalid", "signature does not verify").when(s == "absent", "unsigned")
    outcome = outcome.otherwise(F.concat(F.lit("algorithm "), F.col("algorithm").cast("string"), F.lit(" is not checked")))
    severity = F.when(F.col("error").isNotNull() | s.isNull() | (s == "valid"), "info").when(s == "invalid", "error").otherwise("warn")
    return folders.join(vbmeta.withColumn("_met", F.lit(True)), "dir", "left").select("dir", severity.alias("severity"), outcome.alias("outcome"))
