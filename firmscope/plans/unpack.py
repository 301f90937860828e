"""Nested containers: unpack, identify what came out, and go on until nothing opens.

A loop over generations: each is one distributed pass over the containers of a
depth, and goes to the shared folder. What a handler refuses becomes an error row.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.sources import archives, lz4, sniff, vendor
from firmscope.sources.images import BROKEN, Refused, payload_image, payload_operations, unsparse
from firmscope.tables import saved


@dataclass(frozen=True)
class Limits:
    """Guards against archives that unpack without end."""

    depth: int = 8
    bytes: int = 8 << 30
    files: int = 100_000


def _one(decompress: Callable[[bytes], bytes]) -> Callable[[str, bytes], Iterator[tuple[str, bytes]]]:
    def run(path: str, data: bytes):
        name = re.split("[/!]", path)[-1]
        yield name.rsplit(".", 1)[0] if "." in name[1:] else f"{name}.out", decompress(data)

    return run


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(data).read(Limits().bytes)


def _contained(images: Callable) -> Callable[[str, bytes], Iterator[tuple[str, bytes]]]:
    return lambda _, data: ((r["name"], vendor.image_bytes(data, r)) for r in images(data))


def _payload(_: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    for name in dict.fromkeys(op["partition"] for op in payload_operations(data)):
        yield f"{name}.img", payload_image(data, name)


#: What opens which kind: (path, bytes) to (name, bytes) of what is inside.
HANDLERS: dict[str, Callable[[str, bytes], Iterator[tuple[str, bytes]]]] = {
    "tar": lambda _, data: archives.tar_files(data),
    "zip": lambda _, data: archives.zip_files(data),
    "gzip": _one(gzip.decompress),
    "xz": _one(lzma.decompress),
    "bzip2": _one(bz2.decompress),
    "zstd": _one(_zstd),
    "lz4": _one(lz4.decompress),
    "lz4-legacy": _one(lz4.decompress),
    "ozip": _one(lambda data: b"".join(vendor.ozip_pieces(data))),
    "android-sparse": _one(unsparse),
    "payload-bin": _payload,
    "huawei-update-app": _contained(vendor.huawei_app),
    "lg-kdz": _contained(vendor.lg_kdz),
    "lg-dz": _contained(vendor.lg_dz),
    "sony-sin": _contained(vendor.sony_sin),
    "nokia-nb0": _contained(vendor.nokia_nb0),
    "coolpad-cpb": _contained(vendor.coolpad_cpb),
    "pac": lambda _, data: ((r["name"], data[r["offset"] : r["offset"] + r["size"]]) for r in vendor.pac_files(data)),
}
_FIELDS = "path string, depth int, content binary, error string"


def unpack(files: DataFrame, limits: Limits = Limits(), handlers: dict[str, Callable] | None = None) -> DataFrame:
    """(path, kind, depth, size, content, error): what no handler opens, at any depth.

    Paths of things inside are ``container!name``. files: path, content. More nesting
    or bytes than the limits allow is an error of the whole plan; a container that
    can't be opened, or holds too many files, is a row with its error.
    """
    handlers = HANDLERS if handlers is None else handlers
    frontier = files.select("path", F.lit(0).alias("depth"), "content", F.lit(None).cast("string").alias("error"))
    leaves, total, opened = [], 0, F.col("kind").isin(*handlers) & F.col("error").isNull()
    for depth in range(limits.depth + 2):
        found = frontier.join(sniff.identify(frontier.where("error is null")), "path", "left").withColumn("size", F.octet_length("content").cast("long"))
        leaves.append(found.where(~F.coalesce(opened, F.lit(False))).select("path", "kind", "depth", "size", "content", "error"))
        boxes = found.where(opened).select("path", "kind", "depth", "content")
        seen = boxes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("bytes")).first()
        total += seen["bytes"]
        if total > limits.bytes:
            raise Refused("what is unpacked exceeds the limit")
        if not seen["n"]:
            return reduce(DataFrame.unionByName, leaves)
        if depth >= limits.depth + 1:
            break
        frontier = saved(boxes.mapInArrow(lambda it: _opened(it, handlers, limits.files), _FIELDS), "unpacked")
    raise Refused(f"containers nest deeper than {limits.depth} levels")


def _opened(batches: Iterator[pa.RecordBatch], handlers: dict[str, Callable], most: int) -> Iterator[pa.RecordBatch]:
    types = pa.schema([("path", pa.string()), ("depth", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
    for b in batches:
        for path, kind, depth, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            n = 0
            try:
                for name, data in handlers[kind](path, content.as_py()):
                    n += 1
                    if n > most:
                        raise Refused(f"more than {most} files")
                    yield pa.RecordBatch.from_pylist([{"path": f"{path}!{name}", "depth": depth + 1, "content": data, "error": None}], types)
            except BROKEN as x:
                yield pa.RecordBatch.from_pylist([{"path": path, "depth": depth + 1, "content": None, "error": f"{type(x).__name__}: {x}"}], types)
