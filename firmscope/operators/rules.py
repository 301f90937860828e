"""Audit rules: facts in, findings out. Each rule is a filter; findings are their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.functions import exprs as X
from firmscope.operators import schema as S


def finding(df: DataFrame, rule: Column | str, severity: Column | str, subject: Column, key: Column | None, message: Column, order: int, within: Column, category: str = "security", gap: bool = False) -> DataFrame:
    """Shape rows as findings; ``scan_ord`` is (rule order, order within the rule)."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    name = S.severity_name(as_col(severity))
    return df.select(
        "image",
        as_col(rule).alias("rule"),
        F.lit(category).alias("category"),
        name.alias("severity"),
        S.severity_rank(name).alias("sev_rank"),
        F.col("image").alias("scope"),
        subject.alias("subject"),
        (F.lit("") if key is None else key).alias("key"),
        message.alias("message"),
        F.lit(gap).alias("gap"),
        F.struct(F.lit(order).alias("rule"), within.cast("string").alias("within")).alias("scan_ord"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def seal(findings: DataFrame, located: Column | None = None) -> DataFrame:
    """Add fingerprint and uri."""
    where = F.lit(True) if located is None else located
    return findings.withColumn("fingerprint", X.fingerprint(F.col("rule"), F.col("scope"), F.col("subject"), F.col("key"))).withColumn("uri", X.location_uri(F.col("scope"), F.col("subject"), where))


def prop_findings(props: DataFrame) -> DataFrame:
    """The seven property rules, as one pass: each property row meets at most one."""
    k, v = F.col("key"), F.col("value")
    usb = F.array_contains(F.transform(F.split(v, ","), lambda x: F.trim(x)), "adb")
    tests: list[tuple[str, str, Column]] = [
        ("debuggable-build", "high", (k == "ro.debuggable") & (v == "1")),
        ("insecure-adb", "high", (k == "ro.secure") & (v == "0")),
        ("adb-unauthenticated", "high", (k == "ro.adb.secure") & (v == "0")),
        ("adb-root", "high", (k == "service.adb.root") & (v == "1")),
        ("test-keys", "medium", (k == "ro.build.tags") & v.contains("test-keys")),
        ("debug-build-type", "medium", (k == "ro.build.type") & v.isin("userdebug", "eng")),
        ("adb-by-default", "medium", ((k == "persist.sys.usb.config") & usb) | ((k == "persist.service.adb.enable") & (v == "1"))),
    ]
    rule, severity, place = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for n, (name, level, test) in reversed(list(enumerate(tests))):
        rule, severity, place = F.when(test, name).otherwise(rule), F.when(test, level).otherwise(severity), F.when(test, n).otherwise(place)
    met = props.withColumn("_rule", rule).where("_rule is not null").withColumn("_severity", severity).withColumn("_place", place)
    key = F.when(F.col("_rule") == "adb-by-default", k).otherwise("")
    out = finding(met, F.col("_rule"), F.col("_severity"), F.col("file"), key, F.concat(F.col("file"), F.lit(": "), k, F.lit("="), v), 0, F.format_string("%02d/%012d", "_place", "ord"))
    return out


def file_findings(special: DataFrame) -> DataFrame:
    """su binaries, writable set-id files, and three rollups an image."""
    path = F.col("path")
    su = finding(special.where("su"), "su-binary", "high", path, None, F.concat(path, F.lit(" can give root")), 10, path)
    writable = finding(special.where("writable_setuid"), "writable-setuid", "high", path, None, F.concat(path, F.lit(" is set-id and writable by others: "), X.octal_mode(F.col("mode"))), 11, path)
    rollups = []
    for n, (flag, rule, level, text) in enumerate((("world_writable", "world-writable", "medium", "files are writable by everyone"), ("setuid", "setuid-files", "info", "set-id files"), ("capability", "file-capabilities", "info", "files with capabilities"))):
        counted = special.where(flag).groupBy("image").agg(F.count("*").alias("n"))
        rollups.append(finding(counted, rule, level, F.lit(""), None, F.concat_ws(" ", "n", F.lit(text)), 12 + n, F.lit("")))
    return union([su, writable, *rollups])


def service_findings(services: DataFrame) -> DataFrame:
    """One chain: adbd, else su domain, else shell domain or a shell as command."""
    domain = F.coalesce(X.selinux_type(F.col("seclabel")), F.lit(""))
    shell = (domain == "shell") | F.split_part("command", F.lit(" "), F.lit(1)).endswith("/sh")
    asleep = F.when(F.col("disabled"), "info").otherwise("medium")
    rule = F.when(F.col("name") == "adbd", "adbd-service").when(domain == "su", "su-service").when(shell, "shell-service")
    severity = F.when(F.col("name") == "adbd", asleep).when(domain == "su", "high").otherwise(asleep)
    met = services.withColumn("_rule", rule).where("_rule is not null").withColumn("_severity", severity)
    return finding(met, F.col("_rule"), F.col("_severity"), F.col("file"), F.col("name"), F.concat_ws(" ", F.lit("service"), "name", F.lit("runs"), "command"), 20, F.format_string("%012d", "ord"))


def hit_findings(hits: DataFrame) -> DataFrame:
    return finding(hits, F.col("rule"), F.col("severity"), F.col("path"), F.col("detail"), F.concat_ws(": ", "path", "detail"), 30, F.concat_ws("|", "path", "rule", "detail"))


def elf_issues(elf: DataFrame) -> DataFrame:
    """(image, path, rule, severity): unknown canary or fortify never counts."""
    issue = lambda test, rule, level: F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity")))
    known = F.col("canary").isNotNull()
    issues = F.array(
        issue(F.col("executable") & F.col("no_pie"), "no-pie", "high"),
        issue(F.col("exec_stack"), "exec-stack", "medium"),
        issue(F.col("relro") == "none", "no-relro", "medium"),
        issue((F.col("relro") == "partial") & known, "partial-relro", "low"),
        issue(F.col("canary") == F.lit(False), "no-canary", "low"),
        issue(F.col("fortify") == F.lit(False), "no-fortify", "info"),
    )
    return elf.select("image", "path", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select("image", "path", "i.rule", "i.severity")


def elf_findings(elf: DataFrame) -> DataFrame:
    """One finding a rule and image: count, first three paths; the key lists all paths."""
    by = elf_issues(elf).groupBy("image", "rule", "severity").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    shown = F.array_join(F.slice("paths", 1, 3), ", ")
    return finding(by, F.col("rule"), F.col("severity"), F.lit(""), F.array_join("paths", "\n"), F.concat(F.size("paths").cast("string"), F.lit(" objects: "), shown), 40, F.col("rule"))


def audit_findings(props: DataFrame, special: DataFrame, services: DataFrame, hits: DataFrame, elf: DataFrame | None = None) -> DataFrame:
    parts = [prop_findings(props), file_findings(special), service_findings(services), hit_findings(hits)]
    if elf is not None:
        parts.append(elf_findings(elf))
    return seal(union(parts))
