"""Score, baseline, gate, order and report sinks for findings."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmscope.functions import exprs as X
from firmscope.operators import schema as S

SCORE_MODEL = "android/1"


def score(findings: DataFrame, by: list[str] | None = None, rule: str = "rule") -> DataFrame:
    """(by..., value, coverage_gaps, label): two-level aggregation.

    A rule's findings cost, in quarter points, four times the weight of the worst
    plus one weight for each further one, at most eight weights; a rule's gaps
    cost a flat amount. Without ``by``, no findings still give one row of 100.
    """
    by = by or []
    groups = findings.groupBy(*by, F.col(rule).alias("_rule"), "gap").agg(F.max("sev_rank").alias("worst"), F.count("*").alias("n"))
    w = S.severity_weight(F.col("worst"))
    cost = F.when(F.col("gap"), F.lit(S.GAP_COST)).otherwise(F.least(4 * w + (F.col("n") - 1) * w, 8 * w))
    total = F.coalesce(F.sum(cost), F.lit(0))
    gaps = F.coalesce(F.sum(F.when(F.col("gap"), F.col("n"))), F.lit(0)).cast("bigint")
    value = F.greatest(F.lit(0).cast("bigint"), 100 - F.floor((total + 3) / 4)).cast("bigint")
    out = groups.groupBy(*by).agg(value.alias("value"), gaps.alias("coverage_gaps"))
    return out.withColumn("label", score_label(F.col("value"), F.col("coverage_gaps")))


def score_label(value: Column, gaps: Column) -> Column:
    return F.when((value >= 90) & (gaps > 0), "incomplete").when(value >= 90, "good").when(value >= 60, "needs work").otherwise("critical")


def mark_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """baseline_state: unchanged if the fingerprint is known, else new; gaps are always new."""
    known = baseline.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    state = F.when(F.col("gap") | F.col("_known").isNull(), "new").otherwise("unchanged")
    return findings.join(known, "fingerprint", "left").withColumn("baseline_state", state).drop("_known")


def baseline_counts(marked: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: new, unchanged, fixed. Fixed fingerprints are those no finding has now."""
    fixed = baseline.select("fingerprint").distinct().join(marked.select("fingerprint"), "fingerprint", "left_anti").agg(F.count("*").alias("fixed"))
    state = lambda s: F.count_if(F.col("baseline_state") == s).alias(s)
    now = marked.agg(state("new"), state("unchanged"))
    return now.join(F.broadcast(fixed))  # one row on each side


def gate(findings: DataFrame, threshold: str, with_baseline: bool = False) -> DataFrame:
    """One row: exit_code. 0 nothing at the threshold, 1 findings at it; under a
    baseline 3 for new ones, and gaps never count."""
    least = S.SEVERITIES.index(threshold)
    hit = F.col("sev_rank") >= least
    if with_baseline:
        hit &= ~F.col("gap") & (F.col("baseline_state") == "new")
    return findings.agg(F.coalesce(F.max(F.when(hit, F.lit(3 if with_baseline else 1)).otherwise(0)), F.lit(0)).alias("exit_code"))


def ordered(findings: DataFrame) -> DataFrame:
    """Report order: worst first, then rule, then fingerprint (total)."""
    return findings.orderBy(F.desc("sev_rank"), "rule", "fingerprint")


def top(findings: DataFrame, n: int, *ties: str) -> DataFrame:
    """Worst n, by scan order within a severity; extra columns make the order total."""
    return findings.orderBy(F.desc("sev_rank"), *(ties or ("scan_ord", "fingerprint"))).limit(n)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON string a finding, in scan order, as a ``results`` item."""
    item = F.struct(
        F.col("rule").alias("ruleId"),
        S.sarif_level(F.col("severity")).alias("level"),
        F.struct(X.sanitize(F.col("message")).alias("text")).alias("message"),
        F.when(F.col("uri").isNotNull(), F.array(F.struct(F.struct(F.struct(X.uri_encode(F.col("uri")).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints"),
    )
    return findings.select("scan_ord", F.to_json(item).alias("result")).orderBy("scan_ord", "result")


def sarif_rules(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Rule ids of the report: those known and those seen, sorted."""
    return known.select("rule").union(findings.select("rule")).distinct().orderBy("rule")


def envelope(findings: DataFrame, tool: str = "firmscope", threshold: str | None = None) -> str:
    """The whole report as one JSON text with sorted keys: a driver-side sink, for
    reports that people read; larger sets are written with ``sarif_results``."""
    points = score(findings).first()
    rows: list[dict[str, Any]] = [
        {"id": r["rule"], "category": r["category"], "severity": r["severity"], "subject": r["subject"], "message": r["message"], "fingerprint": r["fingerprint"], "gap": r["gap"]}
        for r in ordered(findings).toLocalIterator()
    ]
    body = {
        "schema": "doctor/1",
        "tool": tool,
        "exit_code": gate(findings, threshold).first()["exit_code"] if threshold else 0,
        "score": {"value": points["value"], "label": points["label"], "model": SCORE_MODEL, "coverage_gaps": points["coverage_gaps"]},
        "findings": rows,
    }
    return json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False)


def manifest(entries: DataFrame) -> DataFrame:
    """Entries per kind of each image."""
    return entries.groupBy("image", "kind").agg(F.count("*").alias("n"))


def case_collisions(entries: DataFrame, policy: str = "rename") -> DataFrame:
    """(image, path, extracted_as) for hosts that don't tell case apart: ``rename`` keeps
    the first of paths that differ in case only and calls the others ``~case2`` and so
    on; ``reject`` makes a job fail that meets one; ``allow`` keeps every name."""
    if policy == "allow":
        return entries.select("image", "path", F.col("path").alias("extracted_as"))
    nth = F.row_number().over(Window.partitionBy("image", F.lower("path")).orderBy("path"))
    others = {"rename": F.concat("path", F.lit("~case"), nth.cast("string")), "reject": F.raise_error(F.concat(F.lit("paths that differ in case only: "), F.col("path"))).cast("string")}
    return entries.select("image", "path", F.when(nth > 1, others[policy]).otherwise(F.col("path")).alias("extracted_as"))


def hard_links(entries: DataFrame) -> DataFrame:
    """Files with the path whose data they share: the first of an inode with several
    links is extracted, later ones link to it and take its checksum."""
    inode = Window.partitionBy("image", "ino").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = F.col("nlink") > 1
    files = entries.where("kind = 'file'")
    return files.select("image", "path", F.when(shared, F.first("path").over(inode)).otherwise(F.col("path")).alias("data_path"), F.when(shared, F.first("sha256").over(inode)).otherwise(F.col("sha256")).alias("sha256"))


#: Lines that a list in a text report has.
TEXT_CAP = 25


def capped_lists(rows: DataFrame, by: str, order: str, line: Column, most: int = TEXT_CAP) -> DataFrame:
    """(by, lines, more): the first ``most`` lines of each list, and how many it has beyond.
    Only those that are shown are gathered; the rest is counted."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order, "_line"))
    some = rows.withColumn("_line", X.sanitize(line)).withColumn("_n", nth)
    shown = F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "_line")))
    lists = some.groupBy(by).agg(F.array_sort(shown).alias("_l"), F.count("*").alias("_all"))
    return lists.select(by, F.transform("_l", lambda x: x["_line"]).alias("lines"), F.greatest(F.col("_all") - most, F.lit(0)).alias("more"))


def diff_digest(changes: DataFrame) -> DataFrame:
    """(image, text): a line of counts by status, then the changes up to the cap."""
    count = lambda s: F.count_if(F.col("status") == s).cast("string")
    head = F.concat(X.sanitize(F.col("image")), F.lit(": "), count("added"), F.lit(" added, "), count("removed"), F.lit(" removed, "), count("modified"), F.lit(" modified, "), count("metadata"), F.lit(" metadata-only, "), count("unchanged"), F.lit(" unchanged"))
    shown = capped_lists(changes.where("status <> 'unchanged'"), "image", "path", F.concat(F.lit("  "), F.rpad("status", 8, " "), F.lit(" /"), F.col("path")))
    tail = F.when(F.col("more") > 0, F.array(F.concat(F.lit("  ... "), F.col("more").cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return changes.groupBy("image").agg(head.alias("head")).join(shown, "image", "left").select("image", F.array_join(F.concat(F.array("head"), F.coalesce("lines", F.array().cast("array<string>")), F.coalesce(tail, F.array().cast("array<string>"))), "\n").alias("text"))


def sarif_document(findings: DataFrame, known: DataFrame, tool: str = "firmscope", version: str = "1") -> str:
    """The whole SARIF 2.1.0 report: a driver-side sink. Of findings that a baseline has
    marked, only new ones are results; the rules are those known and those seen."""
    shown = findings.where("baseline_state = 'new'") if "baseline_state" in findings.columns else findings
    body = {
        "$schema": "https://json.schemastore.org/sarif-2.1.0.json",
        "version": "2.1.0",
        "runs": [
            {
                "tool": {"driver": {"name": tool, "version": version, "rules": [{"id": r["rule"]} for r in sarif_rules(shown, known).toLocalIterator()]}},
                "results": [json.loads(r["result"]) for r in sarif_results(shown).toLocalIterator()],
            }
        ],
    }
    return json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False)


#: Children that a listing of one folder shows.
MAX_CHILDREN = 5000


def listing(entries: DataFrame, folder: str = "") -> DataFrame:
    """Entries right below a folder of each image, folders first, by name, up to the cap;
    ``more`` says how many there are beyond. The order is by path (bytes)."""
    inner = F.substring_index("path", "/", -1)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    here = entries.where(parent == folder).withColumn("name", inner)
    nth = F.row_number().over(Window.partitionBy("image").orderBy(F.col("kind") != "dir", "name"))
    total = F.count("*").over(Window.partitionBy("image"))
    return here.withColumn("_n", nth).withColumn("more", F.greatest(total - MAX_CHILDREN, F.lit(0))).where(F.col("_n") <= MAX_CHILDREN).drop("_n")


def blob_bytes(operations: DataFrame) -> DataFrame:
    """(path, partition, n, blob_bytes): operations and data bytes of each partition of a payload."""
    return operations.where("error is null").groupBy("path", "partition").agg(F.count("*").alias("n"), F.sum("length").alias("blob_bytes"))


#: What a command returns beside the gate's 0, 1 and 3.
USAGE_ERROR, INTERRUPTED = 2, 130
#: The severity from which on a command's gate counts, where none is given.
DEFAULT_THRESHOLD = {"scan": "critical", "audit": None, "diff": "high", "baseline": "low"}


def exit_code(run, threshold: str | None, with_baseline: bool = False) -> int:
    """Run a plan (a function that returns findings) and gate it: 0, 1 or 3 by its
    findings, 2 if it fails, 130 if it is interrupted."""
    try:
        findings = run()
        threshold = threshold or (DEFAULT_THRESHOLD["baseline"] if with_baseline else None)
        return gate(findings, threshold, with_baseline).first()["exit_code"] if threshold else 0
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception:
        return USAGE_ERROR
