"""Two-build comparison: full outer joins, and regressions as anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.functions import exprs as X
from firmscope.operators import rules as R


def pair_images(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image, presence): both, added or removed, by file stem."""
    a = old.select(X.file_stem(F.col("name")).alias("image")).distinct().withColumn("_a", F.lit(True))
    b = new.select(X.file_stem(F.col("name")).alias("image")).distinct().withColumn("_b", F.lit(True))
    presence = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("both")
    return a.join(b, "image", "full").select("image", presence.alias("presence"))


def _differs(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    return out


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], content: list[str], meta: list[str] | None = None) -> DataFrame:
    """(keys..., status, old, new): added, removed, modified, metadata or unchanged.

    Keys are unique on each side. Nulls compare equal to nulls.
    """
    side = lambda d, name: d.select(*keys, F.struct(*[F.col(c) for c in d.columns if c not in keys]).alias(name))
    joined = side(old, "old").join(side(new, "new"), keys, "full")
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(_differs(content), "modified")
        .when(_differs(meta or []), "metadata")
        .otherwise("unchanged")
    )
    return joined.withColumn("status", status).select(*keys, "status", "old", "new")


CONTENT = ["kind", "size", "link", "sha256", "rdev"]
META = ["mode", "uid", "gid", "xattrs"]


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by image and path. A directory on one side only is no change, and an
    unchanged directory isn't counted; its metadata change is."""
    pick = lambda d: d.select("image", "path", *CONTENT, *[c for c in META if c != "xattrs"], F.to_json(F.array_sort(F.map_entries("xattrs"))).alias("xattrs"))
    d = keyed_diff(pick(old), pick(new), ["image", "path"], CONTENT, META)
    directory = F.coalesce("new.kind", "old.kind") == "dir"
    return d.where(~(directory & F.col("status").isin("added", "removed", "unchanged")))


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one that comes last counts."""
    values = [c for c in df.columns if c not in keys and c != "ord"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "ord").alias("v")).select(*keys, "v.*")


def prop_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["image", "file", "key"]
    return keyed_diff(_last(old, keys), _last(new, keys), keys, ["value"]).where("status <> 'unchanged'")


def service_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["image", "file", "name"]
    d = keyed_diff(_last(old, keys), _last(new, keys), keys, ["command", "user", "seclabel", "disabled"])
    return d.where("status <> 'unchanged'").withColumn("status", F.when(F.col("status") == "modified", "changed").otherwise(F.col("status")))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("image", "status").agg(F.count("*").alias("n"))


def new_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings with a subject and above info that the old build hasn't."""
    some = new.where((F.col("subject") != "") & (F.col("severity") != "info"))
    keys = ["image", "rule", "subject", "key"]
    fresh = some.join(old.select(*keys).distinct(), keys, "left_anti")
    return fresh.withColumn("rule", F.concat(F.lit("diff-"), F.col("rule")))


def is_root(user: Column) -> Column:
    return user.isNull() | (user == "root")


def is_policy(path: Column) -> Column:
    ends = [path.endswith(s) for s in ("file_contexts", "property_contexts", "service_contexts", "seapp_contexts")]
    out = path.contains("sepolicy") | path.contains("etc/selinux/")
    for e in ends:
        out = out | e
    return out


def regressions(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """``diff-*`` findings. old and new hold: entries, special, services, findings."""
    path = F.col("path")
    setuid = new["special"].where("setuid").join(old["special"].where("setuid").select("image", "path"), ["image", "path"], "left_anti")
    cap = lambda d: d.select("image", "path", F.element_at("xattrs", "security.capability").alias("value")).where("value is not null")
    caps = cap(new["entries"]).join(cap(old["entries"]), ["image", "path", "value"], "left_anti")
    keys = ["image", "file", "name"]
    before = _last(old["services"], keys).select(*keys, is_root(F.col("user")).alias("_was"))
    root = _last(new["services"], keys).where(is_root(F.col("user"))).join(before, keys, "left").where("_was is null or not _was")
    policy = file_changes(old["entries"], new["entries"]).where(is_policy(path) & F.col("status").isin("added", "removed", "modified"))
    fresh = new_findings(old["findings"], new["findings"]).drop("fingerprint", "uri")
    both = old["entries"].select("image").distinct().join(new["entries"].select("image").distinct(), "image")
    parts = [
        fresh,
        R.finding(setuid, "diff-new-setuid", "high", path, None, F.concat(path, F.lit(" became set-id")), 60, path),
        R.finding(caps, "diff-new-capability", "medium", path, F.col("value"), F.concat(path, F.lit(" gained a capability")), 61, path),
        R.finding(root, "diff-root-service", "high", F.col("file"), F.col("name"), F.concat_ws(" ", F.lit("service"), "name", F.lit("runs as root")), 62, F.concat_ws("|", "file", "name")),
        R.finding(policy, "diff-sepolicy-changed", "medium", path, None, F.concat_ws(" ", "path", "status"), 63, path),
    ]
    return R.seal(R.union(parts).join(both, "image", "left_semi"))
