"""Schemas of the relations, and the severity scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = (
    "image string, path string, kind string, mode int, uid bigint, gid bigint, size bigint, mtime bigint, ino bigint, nlink bigint, "
    "link string, rdev struct<major: bigint, minor: bigint>, xattrs map<string, string>, sha256 string, extracted_as string"
)
CONTENT = "image string, path string, content binary"
PROP = "image string, file string, key string, value string, ord bigint"
SERVICE = "image string, file string, name string, command string, user string, seclabel string, disabled boolean, ord bigint"
ELF = "image string, path string, bits int, big_endian boolean, executable boolean, no_pie boolean, exec_stack boolean, relro string, canary boolean, fortify boolean"
FINDING_COLUMNS = ("image", "rule", "category", "severity", "sev_rank", "scope", "subject", "key", "message", "gap", "scan_ord")

# fixed values: worst last; the names that older reports used
SEVERITIES = ("info", "low", "medium", "high", "critical")
LEGACY = {"error": "critical", "warn": "low"}
WEIGHTS = (0, 2, 5, 10, 20)
GAP_COST = 12


def severity_name(text: Column) -> Column:
    """Unified name; unknown text is info."""
    out = F.lit("info")
    for name in SEVERITIES:
        out = F.when(F.lower(text) == name, name).otherwise(out)
    for old, new in LEGACY.items():
        out = F.when(F.lower(text) == old, new).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    """0 (info) to 4 (critical)."""
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name) - 1).cast("int")


def severity_weight(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), rank + 1)


def sarif_level(name: Column) -> Column:
    return F.when(name.isin("critical", "high"), "error").when(name == "medium", "warning").otherwise("note")
