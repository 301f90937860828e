"""Directory and device rules: partitions, flash manifests, staleness, quality grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.functions import exprs as X
from firmscope.operators import rules as R

EXPECTED = ("system", "vendor", "boot")
GRID_RULES = ("mode_anomalies", "duplicate_properties", "selinux_label_gaps", "init_service_hygiene", "debug_leftovers")


def missing_partitions(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected names (column name) that no image or transfer list of a directory has;
    files: dir, name, is_file. Case doesn't matter."""
    stem = F.regexp_extract(F.lower("name"), r"^(.*?)(\.img|\.transfer\.list)$", 1)
    have = files.where("is_file").select("dir", stem.alias("partition")).where("partition <> ''").distinct()
    grid = files.select("dir").distinct().join(F.broadcast(expected.select(F.lower("name").alias("partition"))))
    return grid.join(have, ["dir", "partition"], "left_anti")


def partition_coverage(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(dir, severity, subject): a warning for each missing image, or one error for a
    folder that has no image and no transfer list at all."""
    stem = F.regexp_extract(F.lower("name"), r"^(.+?)(\.img|\.transfer\.list)$", 1)
    empty = files.groupBy("dir").agg(F.max(F.coalesce(F.col("is_file") & (stem != ""), F.lit(False))).alias("any")).where("not any").select("dir")
    none = empty.select("dir", F.lit("error").alias("severity"), F.lit("images").alias("subject"))
    missing = missing_partitions(files, expected).join(empty, "dir", "left_anti")
    return none.unionByName(missing.select("dir", F.lit("warn").alias("severity"), F.concat("partition", F.lit(".img")).alias("subject")))


def update_gaps(files: DataFrame) -> DataFrame:
    """(dir, rule): quality rules that can't be evaluated where a folder holds an update's
    transfer lists but no image yet; files: dir, name, is_file."""
    has = lambda end: F.max(F.coalesce(F.col("is_file") & F.lower("name").endswith(end), F.lit(False)))
    folders = files.groupBy("dir").agg(has(".img").alias("images"), has(".transfer.list").alias("lists")).where("lists and not images")
    return folders.select("dir", F.explode(F.array(*[F.lit(r) for r in GRID_RULES])).alias("rule"))


def unhandled_input(files: DataFrame, scaffolding: tuple[str, ...] = ("payload_properties.txt", "metadata", "care_map.pb", "compatibility.zip")) -> DataFrame:
    n = F.lower("name")
    known = n.isin(*scaffolding) | n.rlike(r"\.(img|transfer\.list|new\.dat|new\.dat\.br|patch\.dat|json|sha256)$")
    return files.where(F.col("is_file") & ~known).select("dir", "name")


def debug_leftovers(entries: DataFrame) -> DataFrame:
    p = F.lower("path")
    left = p.rlike(r"\.(test|bak|log)$") | p.contains("/test/") | p.endswith("/test")
    return entries.where((F.col("kind") == "file") & left).select("image", "path")


def duplicate_properties(props: DataFrame) -> DataFrame:
    """Keys set more than once in an image; every hit counts, also in one file."""
    return props.groupBy("image", "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("value")).alias("values")).where("n > 1")


def duplicate_services(services: DataFrame) -> DataFrame:
    """Services defined more than once; files in scan order."""
    files = F.transform(F.array_sort(F.collect_list(F.struct("ord", "file"))), lambda x: x["file"])
    return services.groupBy("image", "name").agg(F.count("*").alias("n"), F.array_join(files, " and ").alias("files")).where("n > 1")


def label_gaps(entries: DataFrame) -> DataFrame:
    """Images without files, or without a single label; a part without labels is no gap."""
    file = F.col("kind") == "file"
    by = entries.groupBy("image").agg(F.count_if(file).alias("files"), F.count_if(file & F.map_contains_key("xattrs", "security.selinux")).alias("labelled"))
    return by.where("labelled = 0")


def quality_grid(images: DataFrame, entries: DataFrame, props: DataFrame, services: DataFrame) -> DataFrame:
    """Quality findings of every (image, rule): an image that can't be read gives a gap
    row for each rule, so that nothing passes in silence. images: image, readable."""
    path, none = F.col("path"), F.lit("")
    q = {"category": "quality"}
    mode = entries.where((F.col("kind") == "file") & (F.col("mode").bitwiseAND(F.lit(0o4002)) != 0))
    parts = [
        R.finding(mode, "mode_anomalies", "warn", path, None, F.concat_ws(" ", "path", X.octal_mode(F.col("mode"))), 70, path, **q),
        R.finding(duplicate_properties(props), "duplicate_properties", "warn", F.col("key"), None, F.concat(F.col("key"), F.lit(" is set "), F.col("n").cast("string"), F.lit(" times")), 71, F.col("key"), **q),
        R.finding(duplicate_services(services), "init_service_hygiene", "warn", F.col("name"), None, F.concat(F.col("name"), F.lit(" is defined in "), F.col("files")), 72, F.col("name"), **q),
        R.finding(debug_leftovers(entries), "debug_leftovers", "warn", path, None, F.concat(path, F.lit(" looks left over")), 73, path, **q),
        R.finding(label_gaps(entries), "selinux_label_gaps", "info", F.col("image"), None, F.when(F.col("files") == 0, "no files").otherwise("no labels"), 74, none, gap=True, **q),
    ]
    unread = images.where(~F.col("readable")).select("image", F.explode(F.array(*[F.lit(r) for r in GRID_RULES])).alias("_rule"))
    parts.append(R.finding(unread, F.col("_rule"), "info", F.col("image"), None, F.lit("could not be evaluated"), 75, F.col("_rule"), gap=True, **q))
    return R.seal(R.union(parts))


def manifest_crosscheck(references: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """(name, state): missing (referenced, no such file) or unreferenced, by two anti joins."""
    refs, have = references.select(name).where(F.col(name).isNotNull()).distinct(), files.select(name).distinct()
    missing = refs.join(have, name, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(have.join(refs, name, "left_anti").withColumn("state", F.lit("unreferenced")))


def staleness(patch_level: Column, today: Column) -> tuple[Column, Column]:
    """(age in days, verdict): over a year very stale, over 90 days stale, else ok."""
    age = F.datediff(today, patch_level)
    return age, F.when(age > 365, "very stale").when(age > 90, "stale").when(age.isNotNull(), "ok")


def adb_summary(props: DataFrame) -> DataFrame:
    """One row: the distinct values of the debugging properties over all images, sorted
    and joined by ``/``, and what they mean; root comes before missing authorization."""
    value = lambda key: F.array_sort(F.collect_set(F.when(F.col("key") == key, F.col("value"))))
    s = props.agg(value("ro.secure").alias("secure"), value("ro.adb.secure").alias("adb_secure"), value("ro.debuggable").alias("debuggable"), value("persist.sys.usb.config").alias("usb"))
    root = F.array_contains("debuggable", "1") | F.array_contains("secure", "0")
    unset = (F.size("secure") == 0) & (F.size("adb_secure") == 0) & (F.size("debuggable") == 0)
    verdict = F.when(root, "adbd can run as root").when(F.array_contains("adb_secure", "0"), "ADB needs no authorization").when(unset, "no ADB properties found")
    shown = [F.when(F.size(c) == 0, "not set").otherwise(F.array_join(c, "/")).alias(c) for c in ("secure", "adb_secure", "debuggable", "usb")]
    return s.select(*shown, verdict.otherwise("ADB needs authorization and does not run as root").alias("verdict"))


def resolve_links(entries: DataFrame, hops: int = 8) -> DataFrame:
    """(image, path, target): symlinks followed by at most ``hops`` self joins; null
    where they dangle, loop or leave the image."""
    nodes = entries.select("image", F.col("path").alias("_p"), "kind", "link")
    links = entries.where("kind = 'symlink'")

    def target(path: Column, link: Column) -> Column:
        parent = F.regexp_replace(path, r"[^/]*$", "")
        joined = F.when(link.startswith("/"), F.regexp_replace(link, "^/+", "")).otherwise(F.concat(parent, link))
        plain = F.regexp_replace(joined, r"(^|/)\.(?=/|$)", "$1")
        for _ in range(4):
            plain = F.regexp_replace(plain, r"(^|/)(?!\.\.(?:/|$))[^/]+/\.\.(/|$)", "$1")
        return F.regexp_replace(F.regexp_replace(plain, "/+", "/"), "^/", "")

    at = links.select("image", "path", target(F.col("path"), F.col("link")).alias("target"), F.lit(False).alias("done"))
    for _ in range(hops):
        j = at.join(nodes, (at["image"] == nodes["image"]) & (at["target"] == nodes["_p"]) & ~at["done"], "left").select(at["image"], "path", "target", "done", "kind", "link")
        moving = ~F.col("done") & (F.col("kind") == "symlink")
        lost = ~F.col("done") & F.col("kind").isNull()
        at = j.select("image", "path", F.when(moving, target(F.col("target"), F.col("link"))).when(lost, None).otherwise(F.col("target")).alias("target"), (~moving).alias("done"))
    return at.select("image", "path", F.when(F.col("done"), F.col("target")).alias("target"))
