"""Text sources: OTA metadata, transfer lists, flash manifests, updater scripts, baselines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


MAX_METADATA = 1 << 20


def metadata_errors(files: DataFrame) -> DataFrame:
    """(path, error) of metadata that is too large or has no entry; they are told, not skipped."""
    error = F.when(F.octet_length("text") > MAX_METADATA, "larger than 1 MiB").when(~F.coalesce(F.col("text").contains("="), F.lit(False)), "no key=value entries")
    return files.select("path", error.alias("error")).where("error is not null")


def ota_metadata(files: DataFrame) -> DataFrame:
    """(path, key, value) from ``k=v`` lines (files: path, text); the last duplicate counts.
    Files in ``metadata_errors`` give no rows."""
    lines = files.where(F.octet_length("text") <= MAX_METADATA).select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").contains("="))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    kv = lines.select("path", trim(F.substring_index("line", "=", 1)).alias("key"), trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"), "n")
    return kv.groupBy("path", "key").agg(F.max_by("value", "n").alias("value"))


def transfer_list(files: DataFrame) -> DataFrame:
    """(path, cmd_idx, cmd, begin, end): half-open block ranges of new, zero and erase.

    A bad version, an unknown command, an odd or wrong count and an empty range
    fail the row with ``raise_error``.
    """
    body = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    version = body[0].try_cast("int")
    first = F.when(version >= 2, 4).otherwise(2)
    bad = lambda why: F.raise_error(F.concat(F.col("path"), F.lit(f": {why}")))
    commands = F.when(version.between(1, 4), F.slice(body, first + 1, F.greatest(F.size(body) - first, F.lit(0)))).otherwise(bad("unknown version").cast("array<string>"))
    rows = files.select("path", F.posexplode(commands).alias("cmd_idx", "line"))
    cmd, args = F.split_part("line", F.lit(" "), F.lit(1)), F.split(F.split_part("line", F.lit(" "), F.lit(2)), ",")
    numbers = F.transform(args, lambda x: x.try_cast("bigint"))
    good = cmd.isin("new", "zero", "erase") & (numbers[0] == F.size(numbers) - 1) & (numbers[0] > 0) & (numbers[0] % 2 == 0) & F.forall(numbers, lambda x: x.isNotNull() & (x >= 0))
    checked = F.when(good, numbers).otherwise(bad("broken command").cast("array<bigint>"))
    rows = rows.select("path", "cmd_idx", cmd.alias("cmd"), checked.alias("n"))
    pairs = F.transform(F.sequence(F.lit(0), (F.floor(F.col("n")[0] / 2) - 1).cast("int")), lambda i: F.struct(F.element_at("n", (i * 2 + 2).cast("int")).alias("begin"), F.element_at("n", (i * 2 + 3).cast("int")).alias("end")))
    rows = rows.select("path", "cmd_idx", "cmd", F.posexplode(pairs).alias("range_idx", "r"))
    end = F.when(F.col("r.end") > F.col("r.begin"), F.col("r.end")).otherwise(bad("empty range").cast("bigint"))
    return rows.select("path", "cmd_idx", "range_idx", "cmd", F.col("r.begin").alias("begin"), end.alias("end"))


def image_size(ranges: DataFrame) -> DataFrame:
    """Bytes of the image: the furthest range end."""
    return ranges.groupBy("path").agg((F.max("end") * BLOCK).alias("size"))


def scatter(files: DataFrame) -> DataFrame:
    """(path, label, filename, start, size) of scatter files: white-space fields, ``#`` comments."""
    lines = files.select("path", F.explode(F.split("text", "\r?\n")).alias("line")).select("path", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    f = F.split("line", r"\s+")
    rows = lines.where(F.size(f) >= 3).select("path", f.alias("f"))
    number = lambda c: F.when(c.startswith("0x"), F.conv(F.substring(c, 3, 32), 16, 10).cast("bigint")).otherwise(c.try_cast("bigint"))
    return rows.select("path", F.col("f")[0].alias("label"), F.when(F.size("f") > 3, F.col("f")[3]).alias("filename"), number(F.col("f")[1]).alias("start"), number(F.col("f")[2]).alias("size"))


def rawprogram(files: DataFrame) -> DataFrame:
    """(path, label, filename, start_sector, num_sectors, sparse) of rawprogram XML:
    ``program`` tags, comments left out, attributes in any order."""
    plain = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    tags = files.select("path", F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<program\b([^>]*)>"), F.lit(1))).alias("tag"))
    attr = lambda name: F.nullif(F.regexp_extract("tag", rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    return tags.select("path", attr("label").alias("label"), attr("filename").alias("filename"), attr("start_sector").try_cast("bigint").alias("start_sector"), attr("num_partition_sectors").try_cast("bigint").alias("num_sectors"), (F.lower(attr("sparse")) == "true").alias("sparse"))


def baseline(files: DataFrame) -> DataFrame:
    """(path, fingerprint) of report envelopes or bare arrays; anything else is an
    error, never an empty baseline."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                data = json.loads(text)
                items = data.get("findings") if isinstance(data, dict) else data
                if not isinstance(items, list) or not all(isinstance(x, dict) and isinstance(x.get("fingerprint"), str) for x in items):
                    raise ValueError(f"{path} is not a baseline")
                yield pd.DataFrame({"path": path, "fingerprint": [x["fingerprint"] for x in items]}, columns=["path", "fingerprint"]).astype(str)

    return files.select("path", "text").mapInPandas(parse, "path string, fingerprint string")


_CALL = re.compile(r"([a-z_0-9]+)\s*\(", re.A)


def statements(script: str) -> list[str]:
    """Split an updater script at semicolons outside quotes and comments."""
    out, at, quoted, start = [], 0, False, 0
    while at < len(script):
        c = script[at]
        if quoted and c == "\\":
            at += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "#":
            stop = script.find("\n", at)
            stop = len(script) if stop < 0 else stop
            script = script[:at] + script[stop:]
            continue
        elif not quoted and c == ";":
            out.append(script[start:at].strip())
            start = at + 1
        at += 1
    out.append(script[start:].strip())
    return [s for s in out if s]


def updater_script(files: DataFrame) -> DataFrame:
    """(path, n, call, strings): one row a statement with its quoted strings in order."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                for n, s in enumerate(statements(text or "")):
                    call = _CALL.search(s)
                    strings = [re.sub(r"\\(.)", r"\1", x) for x in re.findall(r'"((?:[^"\\]|\\.)*)"', s)]
                    rows.append((path, n, call[1] if call else None, strings))
            yield pd.DataFrame(rows, columns=["path", "n", "call", "strings"])

    return files.select("path", "text").mapInPandas(parse, "path string, n int, call string, strings array<string>")
