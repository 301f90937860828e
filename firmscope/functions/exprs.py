"""Column expressions shared by the rules: all built-in functions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _zero() -> Column:
    return F.expr("X'00'")


def norm_subject(subject: Column) -> Column:
    """Trim Unicode white space, use forward slashes, drop leading ``./`` and ``/``."""
    trimmed = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.replace(trimmed, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def fingerprint(rule: Column, scope: Column, subject: Column, key: Column) -> Column:
    """First 16 hex digits of SHA-256 over the four parts, each followed by NUL."""
    parts = [x for c in (rule, scope, norm_subject(subject), key) for x in (F.encode(F.coalesce(c, F.lit("")), "UTF-8"), _zero())]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def location_uri(scope: Column, subject: Column, located: Column) -> Column:
    """``scope/subject`` for located findings with a subject, else null."""
    s = norm_subject(subject)
    return F.when(located & (s != ""), F.concat_ws("/", scope, s))


def uri_encode(value: Column) -> Column:
    """Percent-encode all bytes but unreserved characters and ``/``."""
    e = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        e = F.replace(e, F.lit(found), F.lit(wanted))
    return e


# fixed values: file type bits of a mode
_KINDS = ((0o140000, "socket"), (0o120000, "symlink"), (0o100000, "file"), (0o060000, "block"), (0o040000, "dir"), (0o020000, "char"), (0o010000, "fifo"))


def kind_from_mode(mode: Column) -> Column:
    bits = mode.bitwiseAND(F.lit(0o170000))
    out = F.lit("file")
    for value, name in _KINDS:
        out = F.when(bits == value, name).otherwise(out)
    return out


def octal_mode(mode: Column) -> Column:
    """Permission bits as at least four octal digits."""
    digits = F.conv(mode.bitwiseAND(F.lit(0o7777)).cast("string"), 10, 8)
    return F.lpad(digits, 4, "0")


def selinux_type(label: Column) -> Column:
    return F.split_part(label, F.lit(":"), F.lit(3))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(name), r"(?<=.)\.[^.]*$", "")


def archive_stem(name: Column) -> Column:
    """The name without the endings of archives: ``.md5``, then ``.tgz`` and its kind, or
    a compression, ``.tar`` and ``.ozip`` in this order."""
    base = F.regexp_replace(name, r"\.md5$", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"\.(gz|xz|bz2|zst|lz4)$", ""), r"\.tar$", ""), r"\.ozip$", "")
    return F.when(base.rlike(r"\.(tgz|txz|tbz2)$"), F.regexp_replace(base, r"\.(tgz|txz|tbz2)$", "")).otherwise(plain)


# fixed values: control, bidi, zero-width, line and paragraph separators
UNSAFE_CHARS = "[\\u0000-\\u001f\\u007f-\\u009f\\u200b-\\u200f\\u2028-\\u202e\\u2060-\\u2069\\ufeff]"


def sanitize(value: Column) -> Column:
    """Characters that could move or hide text in a terminal become spaces."""
    return F.regexp_replace(value, UNSAFE_CHARS, " ")


def clean_field(value: Column, most: int = 300) -> Column:
    return F.substring(F.replace(sanitize(value), F.lit("`"), F.lit("'")), 1, most)


def shell_quote(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def human_size(size: Column) -> Column:
    """1024-based size with one decimal (ties to even), without a trailing ``.0``."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        shown = F.regexp_replace(F.format_string("%.1f", F.bround(size / F.lit(float(1 << 10 * k)), 1)), r"\.0$", "")
        out = F.when(size >= 1 << 10 * k, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def is_safe_path(path: Column) -> Column:
    """Relative, without ``..`` parts or NUL."""
    return ~path.startswith("/") & ~path.contains("\u0000") & ~path.rlike(r"(^|/)\.\.(/|$)") & (path != "")


def strict_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM`` (its first day) in 1970..9999; null if it is no date."""
    full = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    day = F.when(full.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(full, "yyyy-MM-dd"))
    return F.when(F.year(day) >= 1970, day)


# fixed values: release names by SDK level
ANDROID_RELEASES = {21: "5.0", 22: "5.1", 23: "6.0", 24: "7.0", 25: "7.1", 26: "8.0", 27: "8.1", 28: "9", 29: "10", 30: "11", 31: "12", 32: "12L", 33: "13", 34: "14", 35: "15", 36: "16"}


def android_release(sdk: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ANDROID_RELEASES.items() for x in kv])
    return F.element_at(table, sdk.cast("int"))


def releases_behind(sdk: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(max(ANDROID_RELEASES)) - sdk)


def little_endian(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes at a byte offset."""
    digits = F.concat(*[F.hex(F.substring(data, at + k + 1, 1)) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("bigint")


def big_endian(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("bigint")
