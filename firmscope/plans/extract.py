"""Extraction of update payloads: operations are rows, so one payload is decoded by many
tasks; images are written piece by piece and get their name when they are whole."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmscope.sources.images import BROKEN, Refused, operation_bytes, read_located
from firmscope.sources.remote import open_remote

_OP = "partition string, n int, kind string, offset long, length long, extents array<array<long>>, source array<array<long>>, sha256 string, image_size long, image_sha256 string"
_PIECE = "path string, partition string, n int, begin long, content binary, image_size long, image_sha256 string, error string"


def operations(files: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """Operations of payloads (path, location), with a row that has only an ``error`` for a
    file that can't be read. ``only`` names partitions; names that no file has are errors."""
    rows = read_located(files, "payload").select("path", F.from_json("row", _OP).alias("o"), "error").select("path", "o.*", "error")
    if not only:
        return rows
    known = {r["partition"] for r in rows.where(F.col("partition").isin(*only)).select("partition").distinct().collect()}
    if missing := sorted(set(only) - known):
        raise Refused(f"no such partition: {', '.join(missing)}")
    return rows.where(F.col("partition").isin(*only) | F.col("error").isNotNull())


def pieces(ops: DataFrame, files: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """What the operations write (path, partition, n, begin, content, image_size,
    image_sha256, error), one row an extent. base: partition, base_location of the
    images before the update, for operations that copy or patch them."""
    jobs = ops.where("error is null").join(files.select("path", "location"), "path")
    jobs = jobs.join(base.select("partition", "base_location"), "partition", "left") if base is not None else jobs.withColumn("base_location", F.lit(None).cast("string"))
    jobs = jobs.select("path", "location", "base_location", F.to_json(F.struct("partition", "n", "kind", "offset", "length", "extents", "source", "sha256", "image_size", "image_sha256")).alias("op"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for b in batches:
            for path, location, before, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                op = {"sha256": None, "image_sha256": None} | json.loads(text)
                row = {"path": path, "partition": op["partition"], "n": op["n"], "begin": None, "content": None, "image_size": op["image_size"], "image_sha256": op["image_sha256"], "error": None}
                try:
                    for x in {location, before} - opened.keys() - {None}:
                        opened[x] = open_remote(x)
                    old = None
                    if before is not None:
                        old = lambda at, n, f=opened[before]: f[at : at + n]
                    raw = opened[location][op["offset"] : op["offset"] + op["length"]] if op["length"] else b""
                    body, at, out = operation_bytes(op, raw, old), 0, []
                    for begin, n in op["extents"]:
                        out.append(row | {"begin": begin, "content": body[at : at + n]})
                        at += n
                except BROKEN as x:
                    out = [row | {"error": f"{type(x).__name__}: {x}"}]
                yield pa.RecordBatch.from_pylist(out, _TYPES)

    return jobs.mapInArrow(run, _PIECE)


_TYPES = pa.schema([("path", pa.string()), ("partition", pa.string()), ("n", pa.int32()), ("begin", pa.int64()), ("content", pa.binary()), ("image_size", pa.int64()), ("image_sha256", pa.string()), ("error", pa.string())])
_IMAGE = pa.schema([("partition", pa.string()), ("image", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("error", pa.string())])


def write_images(found: DataFrame, folder: str) -> DataFrame:
    """Write the images of one payload as ``folder/partition.img``; (partition, image, size,
    sha256, error). An image is a ``.part`` file until it is whole and has the hash that
    the payload names; holes are zeros. One task writes an image, in order, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(inner, recursive=True)
        at = None  # (partition, stream, hash, written, size, wanted, error)

        def close() -> dict:
            name, out, digest, written, size, wanted, error = at
            if not error and size > written:
                written += _zeros(out, digest, size - written)
            out.close()
            if not error and wanted and digest.hexdigest() != wanted:
                error = "the image's hash is wrong"
            part, image = f"{inner}/{name}.img.part", f"{inner}/{name}.img"
            if error:
                where.delete_file(part)
            else:
                where.move(part, image)
            return {"partition": name, "image": None if error else image, "size": written, "sha256": digest.hexdigest(), "error": error}

        for b in batches:
            for r in b.to_pylist():
                if at is None or at[0] != r["partition"]:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([close()], _IMAGE)
                    at = [r["partition"], where.open_output_stream(f"{inner}/{r['partition']}.img.part"), hashlib.sha256(), 0, r["image_size"] or 0, r["image_sha256"], None]
                at[6] = at[6] or r["error"]
                if at[6]:
                    continue
                if r["begin"] < at[3]:
                    at[6] = "pieces overlap"
                    continue
                at[3] += _zeros(at[1], at[2], r["begin"] - at[3]) + len(r["content"])
                at[1].write(r["content"])
                at[2].update(r["content"])
        if at is not None:
            yield pa.RecordBatch.from_pylist([close()], _IMAGE)

    rows = found.repartition("partition").sortWithinPartitions("partition", F.col("begin").asc_nulls_first())
    return rows.mapInArrow(run, "partition string, image string, size long, sha256 string, error string")


def _zeros(out, digest, n: int) -> int:
    left = n
    while left > 0:
        piece = bytes(min(left, 1 << 20))
        out.write(piece)
        digest.update(piece)
        left -= len(piece)
    return n
