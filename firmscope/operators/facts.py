"""Facts from entries and file contents: properties, services, special files, hits.

Contents are a table of their own, joined only for the files that a fact needs;
which files those are is decided on metadata, before any byte is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope.functions import exprs as X

# fixed values: property keys that reports look at
ADB_PROPS = ("ro.secure", "ro.debuggable", "ro.adb.secure", "service.adb.root", "persist.sys.usb.config", "persist.service.adb.enable")
BUILD_PROPS = ("ro.build.tags", "ro.build.type", "ro.build.fingerprint", "ro.build.version.security_patch", "ro.build.version.sdk")
MAX_CONTENT_FILE = 2 << 20
MAX_CONTENT_TOTAL = 64 << 20


def is_prop_file(path: Column) -> Column:
    name = X.basename(path)
    return (name == "prop.default") | name.endswith(".prop")


def _lines(contents: DataFrame) -> DataFrame:
    """(image, path, n, line): decoded lines, numbered from 1."""
    text = F.decode("content", "UTF-8")
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return contents.select("image", "path", F.posexplode(lines).alias("n", "line")).withColumn("n", F.col("n") + 1)


def props(contents: DataFrame, keys: tuple[str, ...] = ADB_PROPS + BUILD_PROPS) -> DataFrame:
    """Reported properties: split at the first ``=``, trimmed; same (file, key, value) once.

    ``ord`` numbers them in path and line order, which stands for scan order.
    """
    rows = _lines(contents.where(is_prop_file(F.col("path")))).where(~F.ltrim("line").startswith("#") & F.col("line").contains("="))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = rows.select("image", F.col("path").alias("file"), trim(F.substring_index("line", "=", 1)).alias("key"), trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"), "n")
    rows = rows.where(F.col("key").isin(*keys)).groupBy("image", "file", "key", "value").agg(F.min("n").alias("n"))
    order = Window.partitionBy("image").orderBy("file", "n")
    return rows.withColumn("ord", F.row_number().over(order).cast("bigint")).drop("n")


def services(contents: DataFrame) -> DataFrame:
    """Services of init ``.rc`` files, by segmenting lines at section heads.

    A running count of ``service``, ``on`` and ``import`` lines numbers the
    sections; each service section folds to one row.
    """
    lines = _lines(contents.where(F.col("path").endswith(".rc"))).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    head = F.split_part("line", F.lit(" "), F.lit(1))
    upto = Window.partitionBy("image", "path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sections = lines.withColumn("section", F.sum(F.when(head.isin("service", "on", "import"), 1).otherwise(0)).over(upto))
    words = F.split("line", " ")
    first = F.first(F.when(head == "service", words), ignorenulls=True)
    value = lambda name: F.max(F.when(head == name, F.struct("n", F.element_at(words, 2).alias("v"))))["v"]
    folded = sections.groupBy("image", "path", "section").agg(
        first.alias("head"), value("user").alias("user"), value("seclabel").alias("seclabel"), F.max((F.col("line") == "disabled").cast("int")).alias("disabled"), F.min("n").alias("n")
    )
    folded = folded.where(F.size("head") >= 3)
    order = Window.partitionBy("image").orderBy("path", "n")
    return folded.select(
        "image",
        F.col("path").alias("file"),
        F.col("head")[1].alias("name"),
        F.array_join(F.slice("head", 3, F.size("head")), " ").alias("command"),
        "user",
        "seclabel",
        (F.col("disabled") == 1).alias("disabled"),
        F.row_number().over(order).cast("bigint").alias("ord"),
    )


def special_files(entries: DataFrame) -> DataFrame:
    """Set-id, world-writable and capability files, and su binaries."""
    file, mode = F.col("kind") == "file", F.col("mode")
    dirs = F.split("path", "/")
    inner = F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0)))
    su = (F.col("path") == "su") | ((X.basename(F.col("path")) == "su") & F.arrays_overlap(inner, F.array(*[F.lit(d) for d in ("bin", "xbin", "sbin", "su")])))
    label = F.element_at("xattrs", "security.selinux")
    return entries.select(
        "image",
        "path",
        "mode",
        "uid",
        "gid",
        F.trim(label).alias("label"),
        (file & (mode.bitwiseAND(F.lit(0o6000)) != 0)).alias("setuid"),
        (file & (mode.bitwiseAND(F.lit(0o6000)) != 0) & (mode.bitwiseAND(F.lit(0o022)) != 0)).alias("writable_setuid"),
        (file & (mode.bitwiseAND(F.lit(0o002)) != 0)).alias("world_writable"),
        F.map_contains_key("xattrs", "security.capability").alias("capability"),
        (su | X.selinux_type(F.trim(label)).isin("su_exec", "su")).alias("su"),
    )


# fixed values: markers of private keys and debug endpoints
KEY_MARKERS = ("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----")
DEBUG_MARKERS = ("adb tcpip", "jtag")
CLOUD_KEY = "(?=(AKIA[A-Z0-9]{16}))"


def content_hits(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., rule, severity, detail): marker hits in a text column.

    Keys of cloud accounts count at every offset, overlaps included; every other
    marker counts once a text.
    """
    t = F.col(text)
    found = lambda rule, sev, marker: F.when(t.contains(marker), F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), F.lit(marker).alias("detail")))
    plain = F.array(*[found("hardcoded_credentials", "high", m) for m in KEY_MARKERS], *[found("debug_endpoints", "medium", m) for m in DEBUG_MARKERS])
    cloud = F.transform(F.regexp_extract_all(t, F.lit(CLOUD_KEY), F.lit(1)), lambda k: F.struct(F.lit("cloud_credentials").alias("rule"), F.lit("high").alias("severity"), k.alias("detail")))
    hits = F.concat(F.filter(plain, lambda h: h.isNotNull()), cloud)
    return texts.where(t.isNotNull()).select(*keys, F.explode(hits).alias("h")).select(*keys, "h.rule", "h.severity", "h.detail")


def content_scope(entries: DataFrame) -> DataFrame:
    """Files whose content is searched: not empty, at most 2 MiB each, in path order
    until 64 MiB are read; the budget is looked at before a file is read."""
    some = entries.where((F.col("kind") == "file") & F.col("size").between(1, MAX_CONTENT_FILE))
    before = F.sum("size").over(Window.partitionBy("image").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return some.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < MAX_CONTENT_TOTAL).drop("_before")


def image_content_hits(entries: DataFrame, contents: DataFrame) -> DataFrame:
    scope = content_scope(entries).select("image", "path")
    texts = contents.join(scope, ["image", "path"], "left_semi").select("image", "path", F.decode("content", "UTF-8").alias("text"))
    return content_hits(texts, ["image", "path"]).distinct()


#: Sizes of files that may be native objects, and how many and how much are read an image.
ELF_BYTES, ELF_COUNT, ELF_TOTAL = (52, 64 << 20), 20_000, 512 << 20


def elf_candidates(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((image, path, size) to read, (image, truncated)): shared objects by name and files
    that anyone may execute, in path order, until a count or a total is reached."""
    from pyspark.sql import Window

    maybe = (F.col("kind") == "file") & F.col("size").between(*ELF_BYTES) & (F.col("path").contains(".so") | (F.col("mode").bitwiseAND(F.lit(0o111)) != 0))
    order = Window.partitionBy("image").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    some = entries.where(maybe).select("image", "path", "size").withColumn("_n", F.count("*").over(order)).withColumn("_used", F.sum("size").over(order))
    inside = (F.col("_n") <= ELF_COUNT) & (F.col("_used") <= ELF_TOTAL)
    return some.where(inside).select("image", "path", "size"), some.groupBy("image").agg(F.max(~inside).alias("truncated"))
