"""Whole plans: audit one build, compare two, report against a baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from firmscope.operators import diff, facts, packages, report, rules


@dataclass
class Build:
    """The facts of a build; findings are a plan over them, nothing runs yet."""

    entries: DataFrame
    props: DataFrame
    services: DataFrame
    special: DataFrame
    hits: DataFrame
    findings: DataFrame

    def sides(self) -> dict[str, DataFrame]:
        return {"entries": self.entries, "props": self.props, "services": self.services, "special": self.special, "findings": self.findings}


def audit(entries: DataFrame, contents: DataFrame, elf: DataFrame | None = None, apks: DataFrame | None = None) -> Build:
    """Facts and findings of a build from its entries and file contents."""
    p, s, x, h = facts.props(contents), facts.services(contents), facts.special_files(entries), facts.image_content_hits(entries, contents)
    found = rules.audit_findings(p, x, s, h, elf)
    if apks is not None:
        found = found.unionByName(packages.package_findings(apks))
    return Build(entries, p, s, x, h, found)


@dataclass
class Comparison:
    files: DataFrame
    props: DataFrame
    services: DataFrame
    counts: DataFrame
    findings: DataFrame


def compare(old: Build, new: Build, only: tuple[str, ...] = ()) -> Comparison:
    """Changes and regressions; ``only`` filters the shown changes, never findings. A
    status that doesn't exist is an error."""
    if unknown := sorted(set(only) - {"added", "removed", "modified", "metadata"}):
        raise ValueError(f"no such status: {', '.join(unknown)}")
    files = diff.file_changes(old.entries, new.entries)
    shown = files.where(files["status"].isin(*only)) if only else files.where("status <> 'unchanged'")
    return Comparison(shown, diff.prop_changes(old.props, new.props), diff.service_changes(old.services, new.services), diff.counts(files), diff.regressions(old.sides(), new.sides()))


def gated(findings: DataFrame, threshold: str, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(score over all findings, exit code): a baseline hides rows, it never moves the score."""
    points = report.score(findings)
    if baseline is None:
        return points, report.gate(findings, threshold)
    return points, report.gate(report.mark_baseline(findings, baseline), threshold, with_baseline=True)
