"""Update archives: block images, binary patches, tar with trailer, staged trees."""

from __future__ import annotations

import bz2
import hashlib
import os
import re
import shutil
import struct
import tarfile
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from io import BytesIO
from pathlib import Path

import numpy as np

from firmscope.sources.images import READERS, Refused, _take

BLOCK = 4096


def block_image(commands: Iterable[tuple[str, int, int]], data: bytes) -> bytes:
    """Apply a transfer list (cmd, begin, end in blocks): new data is used in order and
    must be used up exactly; zero and erase leave zeros."""
    rows = list(commands)
    out = bytearray(max((end for _, _, end in rows), default=0) * BLOCK)
    at = 0
    for cmd, begin, end in rows:
        n = (end - begin) * BLOCK
        if cmd == "new":
            out[begin * BLOCK : end * BLOCK] = _take(data, at, n)
            at += n
        elif cmd in ("zero", "erase"):
            out[begin * BLOCK : end * BLOCK] = bytes(n)
        else:
            raise Refused(f"unknown command {cmd}")
    if at != len(data):
        raise Refused(f"{len(data) - at} bytes are left over")
    return bytes(out)


def _signed(data: bytes, at: int) -> int:
    value = struct.unpack("<Q", _take(data, at, 8))[0]
    return -(value & ~(1 << 63)) if value >> 63 else value


def bspatch(old: bytes, patch: bytes) -> bytes:
    """Apply a BSDIFF40 patch: add differences to the old bytes, copy extras, seek."""
    if patch[:8] != b"BSDIFF40":
        raise Refused("not a binary patch")
    n_control, n_diff, size = (_signed(patch, k) for k in (8, 16, 24))
    if min(n_control, n_diff, size) < 0:
        raise Refused("negative sizes")
    control = bz2.decompress(_take(patch, 32, n_control))
    added = bz2.decompress(_take(patch, 32 + n_control, n_diff))
    extra = bz2.decompress(patch[32 + n_control + n_diff :])
    out, at, in_diff, in_extra = bytearray(), 0, 0, 0
    for k in range(0, len(control), 24):
        n_add, n_copy, move = (_signed(control, k + 8 * i) for i in range(3))
        if n_add < 0 or n_copy < 0 or len(out) + n_add + n_copy > size:
            raise Refused("a step leaves the new file")
        piece = np.frombuffer(_take(added, in_diff, n_add), np.uint8).copy()
        low, high = max(at, 0), min(at + n_add, len(old))  # bytes outside of the old file count as zero
        if low < high:
            piece[low - at : high - at] += np.frombuffer(old, np.uint8, high - low, low)
        out += piece.tobytes()
        out += _take(extra, in_extra, n_copy)
        in_diff, in_extra, at = in_diff + n_add, in_extra + n_copy, at + n_add + move
    if len(out) != size:
        raise Refused("the new file is incomplete")
    return bytes(out)


def checked_tar(data: bytes) -> bytes:
    """The tar part of a ``.tar.md5`` file, whose trailer must name its MD5."""
    end = len(data) // 512 * 512
    tail = data[end:].strip()
    if not tail:
        return data
    if hashlib.md5(data[:end]).hexdigest().encode() != tail.split()[0].lower():
        raise Refused("the trailer's checksum is wrong")
    return data[:end]


def tar_files(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of regular files; links and devices are refused."""
    with tarfile.open(fileobj=BytesIO(checked_tar(data))) as t:
        for m in t:
            if m.isdir():
                continue
            if not m.isreg():
                raise Refused(f"{m.name} is not a regular file")
            safe_path(m.name)
            yield m.name, t.extractfile(m).read()


def zip_members(data) -> Iterator[dict]:
    """Members of a zip in the order of its directory; links, devices and unsafe paths are
    refused. ``offset`` is where a member's bytes begin, stored or packed."""
    from firmscope.sources.remote import Remote

    source = _File(data) if isinstance(data, Remote) else BytesIO(data)
    try:
        with zipfile.ZipFile(source) as z:
            for m in z.infolist():
                if m.is_dir():
                    continue
                if (kind := m.external_attr >> 28) not in (0, 0o10):
                    raise Refused(f"{m.filename} is not a regular file (kind {kind:o})")
                n_name, n_extra = struct.unpack("<HH", _take(data, m.header_offset + 26, 4))
                yield {"path": safe_path(m.filename), "size": m.file_size, "packed": m.compress_size, "method": m.compress_type, "offset": m.header_offset + 30 + n_name + n_extra, "encrypted": bool(m.flag_bits & 1)}
    except zipfile.BadZipFile as x:
        raise Refused(str(x)) from x


def zip_files(data: bytes, most: int = 1 << 31) -> Iterator[tuple[str, bytes]]:
    """(path, content) of a zip's files, each within a bound."""
    rows = {r["path"]: r for r in zip_members(data)}
    with zipfile.ZipFile(BytesIO(data)) as z:
        for m in z.infolist():
            if not m.is_dir():
                path = safe_path(m.filename)
                if rows[path]["encrypted"] or m.file_size > most:
                    raise Refused(f"{path} is encrypted or too large")
                with z.open(m) as f:
                    yield path, f.read(most)


class _File:
    """A file object over bytes that are read by ranges."""

    def __init__(self, data):
        self._data, self._at = data, 0

    def seek(self, at: int, whence: int = 0) -> int:
        self._at = at + (0, self._at, len(self._data))[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def seekable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        end = len(self._data) if n is None or n < 0 else self._at + n
        out = bytes(self._data[self._at : end])
        self._at += len(out)
        return out


def safe_path(path: str) -> str:
    """The path without ``.`` parts; absolute paths, ``..`` and NUL are refused."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in parts or "\0" in path or not parts:
        raise Refused(f"unsafe path {path!r}")
    return "/".join(parts)


def joined_pieces(names: Iterable[str], part: str) -> tuple[list[str], bool]:
    """(data files of a partition in reading order, whether they are brotli data): the
    whole file, else numbered pieces, which must follow each other from 0 or 1."""
    names = list(names)
    for end, packed in ((".new.dat.br", True), (".new.dat", False)):
        if part + end in names:
            return [part + end], packed
    for end, packed in ((".new.dat.br.", True), (".new.dat.", False)):
        pieces = sorted((int(n[len(part + end) :]), n) for n in names if re.fullmatch(r"[0-9]+", n[len(part + end) :]) and n.startswith(part + end))
        if pieces:
            first = pieces[0][0]
            if first > 1 or [k for k, _ in pieces] != list(range(first, first + len(pieces))):
                raise Refused(f"{part}: pieces don't follow each other from 0 or 1")
            return [n for _, n in pieces], packed
    raise Refused(f"{part}: no data file and no pieces of one")


def publish(files: Iterable[tuple[str, bytes]], target: str, force: bool = False) -> int:
    """Write a tree beside its target and rename it when all is there; on failure
    nothing is published. A driver-side sink for trees that people asked for."""
    out = Path(target)
    if out.exists() and not force:
        raise FileExistsError(target)
    staging = Path(tempfile.mkdtemp(prefix=f".{out.name}.", dir=out.parent))
    n = 0
    try:
        for path, content in files:
            p = staging / safe_path(path)
            p.parent.mkdir(parents=True, exist_ok=True)
            with p.open("xb") as f:
                f.write(content)
            n += 1
        if out.exists():
            shutil.rmtree(out)
        os.rename(staging, out)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return n


def _tar_rows(data) -> Iterator[dict]:
    for path, content in tar_files(bytes(data[0 : len(data)])):
        yield {"path": path, "size": len(content), "sha256": hashlib.sha256(content).hexdigest()}


READERS |= {"tar": _tar_rows, "zip": zip_members}
