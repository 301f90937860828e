"""Application packages: exported components, manifest flags, signing posture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.operators import rules as R

#: image, path, package, target_sdk, app_permission, components: array of (kind, name,
#: exported, enabled, permission, has_filter, is_main). Unknown flags are null.
PACKAGE = (
    "image string, path string, package string, target_sdk int, app_permission string, debuggable boolean, cleartext boolean, network_config boolean, "
    "shared_user string, test_only boolean, allow_backup boolean, "
    "components array<struct<kind: string, name: string, exported: boolean, enabled: boolean, permission: string, has_filter: boolean, is_main: boolean>>"
)


def exported_components(packages: DataFrame) -> DataFrame:
    """(image, path, label, rule, severity) of components that others can reach unguarded.

    Explicit exports weigh more than those that old target levels imply; disabled
    and guarded components and the launcher activity are left out.
    """
    c = packages.select("image", "path", "package", "target_sdk", "app_permission", F.explode("components").alias("c"))
    provider = F.col("c.kind") == "provider"
    explicit = F.when(provider, "high").otherwise("medium")
    by_default = F.when(provider & (F.col("target_sdk") < 17), "medium").when(~provider & F.col("c.has_filter") & (F.col("target_sdk").isNull() | (F.col("target_sdk") < 31)), "low")
    severity = F.when(F.col("c.exported"), explicit).when(F.col("c.exported").isNull(), by_default)
    open_ = F.coalesce(F.col("c.enabled"), F.lit(True)) & F.col("c.permission").isNull() & F.col("app_permission").isNull() & ~((F.col("c.kind") == "activity") & F.coalesce(F.col("c.is_main"), F.lit(False)))
    rule = F.concat(F.lit("exported-"), F.col("c.kind"))
    found = c.where(open_).withColumn("severity", severity).where("severity is not null")
    return found.select("image", "path", F.concat_ws("/", "package", "c.name").alias("label"), rule.alias("rule"), "severity")


def exported_rollup(found: DataFrame) -> DataFrame:
    """One row for each image, rule and severity: how many, and the first five."""
    by = found.groupBy("image", "rule", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("label")).alias("labels"))
    shown = F.array_join(F.slice("labels", 1, 5), ", ")
    more = F.when(F.col("n") > 5, F.concat(shown, F.lit(" and "), (F.col("n") - 5).cast("string"), F.lit(" more"))).otherwise(shown)
    return by.select("image", "rule", "severity", "n", more.alias("shown"))


def flag_issues(packages: DataFrame) -> DataFrame:
    """(image, path, rule, severity): manifest flags that are set for certain."""
    issue = lambda test, rule, level: F.when(test, F.struct(F.lit(rule).alias("rule"), (F.lit(level) if isinstance(level, str) else level).alias("severity")))
    soft: Column = F.when(F.coalesce(F.col("network_config"), F.lit(False)), "low").otherwise("medium")
    issues = F.array(
        issue(F.col("debuggable"), "apk-debuggable", "high"),
        issue(F.col("cleartext"), "apk-cleartext", soft),
        issue(F.col("shared_user").isNotNull(), "apk-shared-user", "medium"),
        issue(F.col("test_only"), "apk-test-only", "medium"),
        issue(F.col("allow_backup"), "apk-allow-backup", "info"),
    )
    return packages.select("image", "path", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select("image", "path", "i.rule", "i.severity")


def signing_issues(signers: DataFrame, props: DataFrame, now: Column) -> DataFrame:
    """(image, path, rule, severity), once each: v1-only, debug or test certificates,
    expired, not yet valid. signers: image, path, scheme, is_debug_cert,
    is_test_key, not_before, not_after (unix seconds). A debug certificate is
    medium on a debug build, which a property says, and high elsewhere."""
    debug = props.where((F.col("key") == "ro.build.type") & F.col("value").isin("userdebug", "eng")).select("image").distinct().withColumn("_debug", F.lit(True))
    by = signers.groupBy("image", "path").agg(
        F.max((F.col("scheme") != "v1").cast("int")).alias("newer"),
        F.bool_or("is_debug_cert").alias("debug"),
        F.bool_or("is_test_key").alias("test"),
        F.bool_or(F.col("not_after") < now).alias("expired"),
        F.bool_or(F.col("not_before") > now).alias("early"),
    )
    on_debug = F.when(F.coalesce("_debug", F.lit(False)), "medium").otherwise("high")
    issue = lambda test, rule, level: F.when(test, F.struct(F.lit(rule).alias("rule"), level.alias("severity")))
    medium = F.lit("medium")
    issues = F.array(issue(F.col("newer") == 0, "v1-only", medium), issue(F.col("debug"), "debug-certificate", on_debug), issue(F.col("test"), "test-key-certificate", medium), issue(F.col("expired"), "certificate-expired", medium), issue(F.col("early"), "certificate-not-yet-valid", medium))
    rows = by.join(debug, "image", "left").select("image", "path", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i"))
    return rows.select("image", "path", "i.rule", "i.severity")


def package_findings(packages: DataFrame) -> DataFrame:
    rolled = exported_rollup(exported_components(packages))
    exported = R.finding(rolled, F.col("rule"), F.col("severity"), F.lit(""), None, F.concat_ws(": ", F.col("n").cast("string"), "shown"), 50, F.concat_ws("|", "rule", "severity"))
    flags = R.finding(flag_issues(packages), F.col("rule"), F.col("severity"), F.col("path"), None, F.concat_ws(" ", "path", "rule"), 51, F.concat_ws("|", "path", "rule"))
    return R.seal(exported.unionByName(flags))
