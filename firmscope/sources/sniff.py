"""Identify files by their first bytes: one ordered chain of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.functions import exprs as X

SNIFF_LEN = 4100

# fixed values: format ids and magic numbers by offset, in the order in which they are tried
MAGICS: tuple[tuple[str, int, str], ...] = (
    ("zip", 0, "504B0304"),
    ("zip", 0, "504B0506"),
    ("payload-bin", 0, "43724155"),
    ("boot-image", 0, "414E44524F494421"),
    ("vendor-boot", 0, "564E4452424F4F54"),
    ("avb-vbmeta", 0, "41564230"),
    ("android-sparse", 0, "3AFF26ED"),
    ("dtbo", 0, "D7B7AB1E"),
    ("fdt", 0, "D00DFEED"),
    ("ozip", 0, "4F50504F454E435259505421"),
    ("gzip", 0, "1F8B08"),
    ("xz", 0, "FD377A585A00"),
    ("bzip2", 0, "425A68"),
    ("lz4", 0, "04224D18"),
    ("lz4-legacy", 0, "02214C18"),
    ("cpio", 0, "303730373031"),
    ("cpio", 0, "303730373032"),
    ("aml-container", 0, "40414D4C"),
    ("zstd", 0, "28B52FFD"),
    ("huawei-update-app", 0, "55AA5AA5"),
    ("lg-kdz", 0, "2405000038312580"),
    ("lg-kdz", 0, "2805000034312580"),
    ("lg-dz", 0, "32961874"),
    ("sony-sin", 0, "0353494E"),
    ("tar", 257, "7573746172"),
)
# fixed values: formats that only the file name tells
BY_EXTENSION = {"sin": "sony-sin", "cpb": "coolpad-cpb", "nb0": "nokia-nb0"}
EXT4_INCOMPAT = 0x40 | 0x80 | 0x100 | 0x200 | 0x400 | 0x1000 | 0x2000 | 0x4000 | 0x8000 | 0x10000 | 0x20000
EXT4_RO_COMPAT = 0x8 | 0x10 | 0x20 | 0x40 | 0x100 | 0x200 | 0x400 | 0x2000 | 0x8000


def _at(head: Column, at: int, magic: str) -> Column:
    return F.hex(F.substring(head, at + 1, len(magic) // 2)) == magic


def filesystem(head: Column) -> Column:
    """f2fs, erofs, ext2/3/4 by superblock; null if none."""
    compat, incompat, ro = (X.little_endian(head, 1024 + at, 4) for at in (0x5C, 0x60, 0x64))
    ext4 = (incompat.bitwiseAND(F.lit(EXT4_INCOMPAT)) != 0) | (ro.bitwiseAND(F.lit(EXT4_RO_COMPAT)) != 0)
    ext = F.when(ext4, "ext4").when(compat.bitwiseAND(F.lit(0x4)) != 0, "ext3").otherwise("ext2")
    return F.when(_at(head, 1024, "1020F5F2"), "f2fs").when(_at(head, 1024, "E2E1F5E0"), "erofs").when(_at(head, 1080, "53EF"), ext)


def sniff(head: Column) -> Column:
    """The first kind whose magic matches; ``unknown`` otherwise."""
    out = F.when(filesystem(head).isNotNull(), filesystem(head)).when(_at(head, 4096, "67446C61"), "lp-super").otherwise("unknown")
    for kind, at, magic in reversed(MAGICS):
        test = _at(head, at, magic)
        if kind == "bzip2":
            test &= F.hex(F.substring(head, 4, 1)).between("31", "39")
        out = F.when(test, kind).otherwise(out)
    return out


def identify(files: DataFrame, members: DataFrame | None = None, content: str = "content", path: str = "path") -> DataFrame:
    """(path, kind): by bytes, and by extension only where the bytes say nothing.

    ``members`` (path, name) lists what zips hold; with it, zips are told apart as
    A/B updates (``payload.bin``), block updates (a transfer list at the top) and
    others. A ``.pac`` file needs a name where its table begins.
    """
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    named = F.hex(F.substring(content, 61, 64)).rlike("[1-9A-F]") & (F.octet_length(content) >= 124)
    kind = sniff(F.substring(content, 1, SNIFF_LEN))
    other = F.lit("unknown")
    for end, name in BY_EXTENSION.items():
        other = F.when(ending == end, name).otherwise(other)
    kind = F.when((kind != "zip") & (ending == "pac") & named, "pac").when(kind == "unknown", other).otherwise(kind)
    found = files.select(path, kind.alias("kind"))
    if members is None:
        return found
    ab = F.max(F.col("name") == "payload.bin").alias("_ab")
    block = F.max(F.col("name").endswith(".transfer.list") & ~F.col("name").contains("/")).alias("_block")
    told = F.when((F.col("kind") == "zip") & F.col("_ab"), "ab-ota-zip").when((F.col("kind") == "zip") & F.col("_block"), "block-ota-zip").otherwise(F.col("kind"))
    return found.join(members.groupBy(path).agg(ab, block), path, "left").select(path, told.alias("kind"))


def identify_folders(files: DataFrame) -> DataFrame:
    """(path, kind) of folders, from their files (dir, name): block updates hold transfer lists."""
    lists = F.max(F.col("name").endswith(".transfer.list"))
    return files.groupBy(F.col("dir").alias("path")).agg(F.when(lists, "block-ota-dir").otherwise("directory").alias("kind"))


def identify_paths(spark: SparkSession, *paths: str) -> DataFrame:
    return identify(spark.read.format("binaryFile").load(list(paths)))
