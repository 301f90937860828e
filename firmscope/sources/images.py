"""Byte sources: container and image readers that turn bytes into rows.

Each reader is a pure function over ``bytes`` that checks every bound, and
``read`` runs it over (path, content) rows: what a reader refuses becomes an
error row, never a lost row or a failed job.
"""

from __future__ import annotations

import bz2
import hashlib
import json
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_ITEMS = 1_000_000


class Refused(ValueError):
    """The input is not what the reader reads, or breaks its rules."""


def _take(data: bytes, at: int, n: int) -> bytes:
    if at < 0 or n < 0 or at + n > len(data):
        raise Refused(f"{n} bytes at {at} are outside of {len(data)}")
    return data[at : at + n]


def _inside(data: bytes, at: int, n: int) -> None:
    """Refuse a range outside of the data, without reading it."""
    if at < 0 or n < 0 or at + n > len(data):
        raise Refused(f"{n} bytes at {at} are outside of {len(data)}")


def _unpack(fmt: str, data: bytes, at: int = 0) -> tuple:
    return struct.unpack(fmt, _take(data, at, struct.calcsize(fmt)))


# fixed values: sparse chunk kinds
SPARSE_KINDS = {0xCAC1: "raw", 0xCAC2: "fill", 0xCAC3: "skip", 0xCAC4: "crc32"}


def sparse_chunks(data: bytes) -> Iterator[dict]:
    """Chunks of an Android sparse image: kind, blocks, where they go and come from."""
    magic, major, _, head, chunk_head, block, total, count, _ = _unpack("<IHHHHIIII", data)
    if magic != 0xED26FF3A or major != 1 or head < 28 or chunk_head < 12 or not block or block % 4:
        raise Refused("not a sparse image")
    at, out_block = head, 0
    for n in range(count):
        kind, _, blocks, size = _unpack("<HHII", data, at)
        body = at + chunk_head
        if kind not in SPARSE_KINDS or size < chunk_head:
            raise Refused(f"chunk {n} is broken")
        wanted = {"raw": blocks * block, "fill": 4, "skip": 0, "crc32": 4}[SPARSE_KINDS[kind]]
        if size - chunk_head != wanted:
            raise Refused(f"chunk {n} has the wrong size")
        _inside(data, body, wanted)
        yield {"n": n, "kind": SPARSE_KINDS[kind], "blocks": blocks, "begin": out_block * block, "offset": body, "size": wanted}
        out_block += 0 if SPARSE_KINDS[kind] == "crc32" else blocks
        at += size
    if out_block != total:
        raise Refused(f"{out_block} blocks instead of {total}")


#: Images larger than this are refused, whatever their header says.
MAX_IMAGE = 64 << 30
_PIECE = 4 << 20


def sparse_pieces(data: bytes, check: bool = True) -> Iterator[tuple[int, bytes]]:
    """(begin, bytes) of what a sparse image writes, in pieces; holes are left out."""
    block, total = _unpack("<II", data, 12)
    if block * total > MAX_IMAGE:
        raise Refused("the image is too large")
    crc = 0
    for c in sparse_chunks(data):
        size = c["blocks"] * block
        if c["kind"] == "crc32":
            if check and crc != _unpack("<I", data, c["offset"])[0]:
                raise Refused("checksum mismatch")
            continue
        fill = data[c["offset"] : c["offset"] + 4] if c["kind"] == "fill" else b"\0\0\0\0"
        for at in range(0, size, _PIECE):
            n = min(_PIECE, size - at)
            piece = data[c["offset"] + at : c["offset"] + at + n] if c["kind"] == "raw" else fill * (n // 4)
            crc = zlib.crc32(piece, crc) if check else 0
            if c["kind"] != "skip":
                yield c["begin"] + at, piece


def unsparse(*inputs: bytes, most: int = 1 << 31) -> bytes:
    """The whole image of one sparse file, or of several that overlay each other: they
    must agree on the size, and checksums count only where there is one file."""
    sizes = {_unpack("<II", data, 12) for data in inputs}
    if len(sizes) != 1:
        raise Refused("the files are not of one image")
    block, total = sizes.pop()
    if block * total > most:
        raise Refused("the image is too large for one buffer; take its pieces")
    out = bytearray(block * total)
    for data in inputs:
        for at, piece in sparse_pieces(data, check=len(inputs) == 1):
            out[at : at + len(piece)] = piece
    return bytes(out)


def _protobuf(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = _take(data, at, 1)[0]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7
            if shift > 63:
                raise Refused("number too long")

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, _take(data, at, n)
            at += n
        elif kind == 2:
            n = varint()
            yield tag >> 3, _take(data, at, n)
            at += n
        else:
            raise Refused("unknown wire type")


# fixed values: operation types of update payloads
PAYLOAD_OPS = {0: "replace", 1: "replace_bz", 4: "source_copy", 5: "source_bsdiff", 6: "zero", 7: "discard", 8: "replace_xz", 14: "replace_zstd"}


MAX_BLOB = 512 << 20


def payload_operations(data: bytes) -> Iterator[dict]:
    """Operations of an update payload: partition, kind, source, destination and data
    ranges, with the size and hash that the partition is to have (no hash where the
    device adds a hash tree or error correction to it)."""
    magic, version, size, _ = _unpack(">4sQQI", data)
    if magic != b"CrAU" or version != 2 or size > 64 << 20:
        raise Refused("not a version 2 payload")
    signature = _unpack(">I", data, 20)[0]
    manifest = _take(data, 24, size)
    blob, block = 24 + size + signature, 4096
    parts: list[bytes] = []
    for field, value in _protobuf(manifest):
        if field == 3 and isinstance(value, int):
            block = value
        elif field == 13 and isinstance(value, bytes):
            parts.append(value)
    if not 512 <= block <= 1 << 20 or block % 512:
        raise Refused("bad block size")
    seen: set[str] = set()
    for part in parts:
        fields = list(_protobuf(part))
        name = b"".join(v for f, v in fields if f == 1 and isinstance(v, bytes)).decode()
        if not name or "/" in name or name.startswith(".") or name.lower() in seen:
            raise Refused(f"bad partition name {name!r}")
        seen.add(name.lower())
        covered: list[tuple[int, int]] = []
        info = dict(_protobuf(b"".join(v for f, v in fields if f == 7 and isinstance(v, bytes))))
        size, digest = int(info.get(1, 0)), info[2].hex() if isinstance(info.get(2), bytes) else None
        if size > MAX_IMAGE:
            raise Refused(f"{name}: the image is too large")
        if any(f in (11, 15) for f, _ in fields):
            digest = None
        for n, op in enumerate(v for f, v in fields if f == 8 and isinstance(v, bytes)):
            plain: dict[int, int | bytes] = {}
            extents, source = [], []
            for f, v in _protobuf(op):
                if f in (4, 6) and isinstance(v, bytes):
                    e = dict(_protobuf(v))
                    (extents if f == 6 else source).append((int(e.get(1, 0)) * block, int(e.get(2, 0)) * block))
                else:
                    plain[f] = v
            kind = PAYLOAD_OPS.get(int(plain.get(1, 0)))
            if kind is None:
                raise Refused(f"{name}: unknown operation {plain.get(1)}")
            offset, length = blob + int(plain.get(2, 0)), int(plain.get(3, 0))
            if kind.startswith("replace") or kind == "source_bsdiff":
                if length > MAX_BLOB:
                    raise Refused(f"{name}: the data of an operation is too large")
                _inside(data, offset, length)
            covered += [(b, b + s) for b, s in extents]
            if max((b + s for b, s in extents), default=0) > (size if size else MAX_IMAGE):
                raise Refused(f"{name}: an operation writes behind the image's end")
            yield {"partition": name, "n": n, "kind": kind, "offset": offset, "length": length, "extents": extents, "source": source, "sha256": plain[8].hex() if isinstance(plain.get(8), bytes) else None, "image_size": size, "image_sha256": digest}
        covered.sort()
        if any(a[1] > b[0] for a, b in zip(covered, covered[1:], strict=False)):
            raise Refused(f"{name}: destinations overlap")


def operation_bytes(op: dict, raw: bytes, base: Callable[[int, int], bytes] | None = None) -> bytes:
    """What one operation writes, checked against its hash and its destination's size;
    ``base`` reads the image before the update, for operations that copy or patch it."""
    size = sum(n for _, n in op["extents"])
    if op["sha256"] and hashlib.sha256(raw).hexdigest() != op["sha256"]:
        raise Refused(f"operation {op['n']}: hash mismatch")
    kind = op["kind"]
    if kind in ("zero", "discard"):
        return bytes(size)
    if kind == "replace":
        body = raw
    elif kind == "replace_bz":
        body = bz2.BZ2Decompressor().decompress(raw, size + 1)
    elif kind == "replace_xz":
        body = lzma.LZMADecompressor().decompress(raw, size + 1)
    elif kind == "replace_zstd":
        import zstandard

        body = zstandard.ZstdDecompressor().stream_reader(raw).read(size + 1)
    elif base is None:
        raise Refused(f"{kind} needs the image before the update")
    else:
        old = b"".join(base(at, n) for at, n in op["source"])
        if kind == "source_copy":
            body = old
        else:
            from firmscope.sources.archives import bspatch

            body = bspatch(old, raw)
    if len(body) > size:
        raise Refused(f"operation {op['n']} is longer than its destination")
    return body + bytes(size - len(body))


def payload_image(data: bytes, partition: str, base: bytes | None = None, most: int = 1 << 31) -> bytes:
    """The bytes of one partition, for images that fit one buffer; ``base`` is the image
    before the update. Hashes of operations and of the whole image are checked."""
    out, digest = bytearray(), None
    before = None if base is None else lambda at, n: _take(base, at, n)
    for op in payload_operations(data):
        if op["partition"] != partition:
            continue
        digest = op["image_sha256"]
        body, at = operation_bytes(op, data[op["offset"] : op["offset"] + op["length"]], before), 0
        for begin, n in op["extents"]:
            if begin + n > most:
                raise Refused("the image is too large for one buffer; take its operations")
            if len(out) < begin + n:
                out.extend(bytes(begin + n - len(out)))
            out[begin : begin + n] = body[at : at + n]
            at += n
    if digest and hashlib.sha256(out).hexdigest() != digest:
        raise Refused(f"{partition}: the image's hash is wrong")
    return bytes(out)


def elf_audit(data: bytes) -> dict:
    """Hardening facts of one ELF object; canary and fortify are null without symbols."""
    if data[:4] != b"\x7fELF" or data[4:5] not in (b"\x01", b"\x02") or data[5:6] not in (b"\x01", b"\x02"):
        raise Refused("not an ELF object")
    wide, e = data[4] == 2, "<" if data[5] == 1 else ">"
    kind = _unpack(e + "H", data, 16)[0]
    phoff = _unpack(e + ("Q" if wide else "I"), data, 32 if wide else 28)[0]
    phsize, phnum = _unpack(e + "HH", data, 54 if wide else 42)
    interp = dynamic = relro = False
    exec_stack, dyn, loads = False, (0, 0), []
    has_stack = False
    for k in range(phnum):
        at = phoff + k * phsize
        if wide:
            t, flags, offset, vaddr, _, size = _unpack(e + "IIQQQQ", data, at)
        else:
            t, offset, vaddr, _, size, _, flags = _unpack(e + "IIIIIII", data, at)
        if t == 1:
            loads.append((vaddr, offset, size))
        elif t == 2:
            dynamic, dyn = True, (offset, size)
        elif t == 3:
            interp = True
        elif t == 0x6474E551:
            has_stack, exec_stack = True, bool(flags & 1)
        elif t == 0x6474E552:
            relro = True
    tags: dict[int, int] = {}
    step = 16 if wide else 8
    for at in range(dyn[0], dyn[0] + dyn[1] - step + 1, step):
        tag, value = _unpack(e + ("QQ" if wide else "II"), data, at)
        if tag == 0:
            break
        tags[tag] = value
    now = 24 in tags or bool(tags.get(30, 0) & 8) or bool(tags.get(0x6FFFFFFB, 0) & 1)
    names = None
    if 5 in tags and 10 in tags:
        for vaddr, offset, size in loads:
            if vaddr <= tags[5] and tags[5] + tags[10] <= vaddr + size:
                names = _take(data, offset + tags[5] - vaddr, tags[10])
    return {
        "bits": 64 if wide else 32,
        "big_endian": e == ">",
        "executable": kind == 2 or (kind == 3 and interp),
        "no_pie": kind == 2,
        "exec_stack": exec_stack and has_stack,
        "relro": "none" if not relro else "full" if now else "partial",
        "canary": None if names is None else b"__stack_chk_fail" in names,
        "fortify": None if names is None else b"_chk\0" in names.replace(b"__stack_chk_fail", b""),
        "dynamic": dynamic,
    }


def cpio_entries(data: bytes) -> Iterator[dict]:
    """Entries of concatenated newc archives; padding between archives is skipped."""
    at = n = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        head = _take(data, at, 110)
        if head[:6] not in (b"070701", b"070702"):
            raise Refused(f"no header at {at}")
        try:
            ino, mode, uid, gid, nlink, mtime, size, _, _, major, minor, n_name, _ = (int(head[6 + 8 * k : 14 + 8 * k], 16) for k in range(13))
        except ValueError as x:
            raise Refused("broken header") from x
        name = _take(data, at + 110, n_name).rstrip(b"\0").decode("utf-8", "replace")
        body = at + (110 + n_name + 3) // 4 * 4
        if name == "TRAILER!!!":
            at = body
            continue
        n += 1
        if n > MAX_ITEMS:
            raise Refused("too many entries")
        content = _take(data, body, size)
        yield {"path": name.removeprefix("./").lstrip("/"), "mode": mode, "uid": uid, "gid": gid, "size": size, "mtime": mtime, "ino": ino, "nlink": nlink, "rdev": [major, minor], "link": content.decode("utf-8", "replace") if mode & 0o170000 == 0o120000 else None, "offset": body}
        at = body + (size + 3) // 4 * 4


def decompressed_ramdisk(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        return zlib.decompress(data, 31)
    if data[:6] == b"\xfd7zXZ\0" or data[:3] == b"\x5d\0\0":
        return lzma.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if data[:4] in (b"\x02\x21\x4c\x18", b"\x04\x22\x4d\x18"):
        from firmscope.sources import lz4

        return lz4.decompress(data)
    return data


def boot_sections(data: bytes) -> Iterator[dict]:
    """Sections of boot images, versions 0 to 4."""
    if data[:8] != b"ANDROID!":
        raise Refused("not a boot image")
    version = _unpack("<I", data, 40)[0]
    if version > 4:
        raise Refused(f"unknown version {version}")
    if version >= 3:
        kernel, ramdisk = _unpack("<II", data, 8)
        page, sizes = 4096, [("kernel", kernel), ("ramdisk", ramdisk)]
        if version == 4:
            sizes.append(("signature", _unpack("<I", data, 1580)[0]))
    else:
        kernel, _, ramdisk, _, second, _, _, page = _unpack("<8I", data, 8)
        sizes = [("kernel", kernel), ("ramdisk", ramdisk), ("second", second)]
        if version >= 1:
            sizes.append(("recovery_dtbo", _unpack("<I", data, 1632)[0]))
        if version == 2:
            sizes.append(("dtb", _unpack("<I", data, 1648)[0]))
        if page < 512 or page & (page - 1):
            raise Refused("bad page size")
    at = page
    for name, size in sizes:
        if size:
            _take(data, at, size)
            yield {"name": name, "offset": at, "size": size, "version": version}
        at += -(-size // page) * page


def super_partitions(data: bytes) -> Iterator[dict]:
    """Partitions of a super image with their extents (512-byte sectors)."""
    for where in (4096, 8192):  # the second one is a copy
        geometry = _take(data, where, 52)
        magic, size = struct.unpack_from("<II", geometry)
        if magic == 0x616C4467 and size == 52 and hashlib.sha256(geometry[:8] + bytes(32) + geometry[40:size]).digest() == geometry[8:40]:
            break
    else:
        raise Refused("no geometry")
    head_at = 4096 + 2 * 4096
    magic, major, _, head_size = _unpack("<IHHI", data, head_at)
    header = _take(data, head_at, head_size)
    if magic != 0x414C5030 or major != 10 or hashlib.sha256(header[:12] + bytes(32) + header[44:]).digest() != header[12:44]:
        raise Refused("no metadata")
    tables_size = struct.unpack_from("<I", header, 44)[0]
    tables = _take(data, head_at + head_size, tables_size)
    if hashlib.sha256(tables).digest() != header[48:80]:
        raise Refused("damaged tables")

    def rows(k: int) -> list[bytes]:
        offset, count, width = struct.unpack_from("<III", header, 80 + 12 * k)
        return [_take(tables, offset + i * width, width) for i in range(count)]

    extents = [struct.unpack_from("<QIQI", r) for r in rows(1)]
    for r in rows(0):
        name = r[:36].rstrip(b"\0").decode()
        _, first, count = struct.unpack_from("<III", r, 36)
        if first + count > len(extents):
            raise Refused(f"{name}: extents are missing")
        mine = extents[first : first + count]
        if any(kind not in (0, 1) for _, kind, _, _ in mine):
            raise Refused(f"{name}: unknown extent kind")
        yield {"name": name, "first": first, "count": count, "size": sum(n for n, *_ in mine) * 512, "extents": [[n * 512, kind, at * 512] for n, kind, at, _ in mine]}


def super_slice(data: bytes, partition: dict, at: int, size: int) -> bytes:
    """A range of a partition of ``super_partitions``, from its extents; zero ones are zeros."""
    out, begin = [], 0
    for length, kind, where in partition["extents"]:
        low, high = max(at, begin), min(at + size, begin + length)
        if low < high:
            out.append(bytes(_take(data, where + low - begin, high - low)) if kind == 0 else bytes(high - low))
        begin += length
    if at < 0 or size < 0 or at + size > begin:
        raise Refused(f"{size} bytes at {at} are outside of the partition")
    return b"".join(out)


# fixed values: descriptor kinds of vbmeta
DESCRIPTORS = {0: "property", 1: "hashtree", 2: "hash", 3: "kernel_cmdline", 4: "chain_partition"}


def vbmeta_descriptors(data: bytes) -> Iterator[dict]:
    """Descriptors of a vbmeta image, or of the one that a footer names."""
    if data[-64:-60] == b"AVBf" and data[:4] != b"AVB0":
        at, size = _unpack(">QQ", data, len(data) - 64 + 20)
        data = _take(data, at, size)
    if data[:4] != b"AVB0":
        raise Refused("no vbmeta")
    auth, aux = _unpack(">QQ", data, 12)
    algorithm = _unpack(">I", data, 28)[0]
    where, size = _unpack(">QQ", data, 96)
    rollback, flags = _unpack(">QI", data, 112)
    base = 256 + auth
    _take(data, base, aux)
    at, end, n = base + where, base + where + size, 0
    if end > base + aux:
        raise Refused("descriptors reach outside")
    while at < end:
        tag, follow = _unpack(">QQ", data, at)
        body = _take(data, at + 16, follow)
        out = {"n": n, "kind": DESCRIPTORS.get(tag, f"unknown-{tag}"), "algorithm": algorithm, "flags": flags, "rollback_index": rollback, "partition": None, "digest": None, "key": None, "value": None}
        if tag == 0:
            k, v = _unpack(">QQ", body)
            out |= {"key": _take(body, 16, k).decode(), "value": _take(body, 17 + k, v).decode("utf-8", "replace")}
        elif tag == 2:
            name, salt, digest = _unpack(">III", body, 40)
            out |= {"partition": _take(body, 116, name).decode(), "digest": _take(body, 116 + name + salt, digest).hex()}
        elif tag == 1:
            name, salt, digest = _unpack(">III", body, 88)
            out |= {"partition": _take(body, 164, name).decode(), "digest": _take(body, 164 + name + salt, digest).hex()}
        elif tag == 4:
            location, name, _ = _unpack(">III", body)
            out |= {"partition": _take(body, 76, name).decode(), "value": str(location)}
        yield out
        at, n = at + 16 + follow, n + 1


def fdt_nodes(data: bytes) -> Iterator[dict]:
    """Properties of a device tree, flattened to (node, name, value)."""
    magic, total, struct_at, strings_at = _unpack(">IIII", data)
    if magic != 0xD00DFEED or total > len(data):
        raise Refused("not a device tree")
    at, path = struct_at, []
    while True:
        token = _unpack(">I", data, at)[0]
        at += 4
        if token == 1:
            stop = data.index(b"\0", at)
            path.append(data[at:stop].decode("utf-8", "replace"))
            at = (stop + 4) // 4 * 4
            if len(path) > 64:
                raise Refused("nested too deep")
        elif token == 2:
            if not path:
                raise Refused("one end too many")
            path.pop()
        elif token == 3:
            size, name_at = _unpack(">II", data, at)
            start = strings_at + name_at
            name = data[start : data.index(b"\0", start)].decode("utf-8", "replace")
            yield {"node": "/" + "/".join(path[1:]), "name": name, "value": _take(data, at + 8, size).hex()}
            at += 8 + (size + 3) // 4 * 4
        elif token == 9:
            return
        elif token != 4:
            raise Refused(f"unknown token {token}")


READERS: dict[str, Callable[[bytes], Iterator[dict]]] = {
    "sparse": sparse_chunks,
    "payload": payload_operations,
    "elf": lambda data: iter([elf_audit(data)]),
    "cpio": lambda data: cpio_entries(decompressed_ramdisk(data)),
    "boot": boot_sections,
    "super": super_partitions,
    "vbmeta": vbmeta_descriptors,
    "fdt": fdt_nodes,
}


#: What a reader may raise on bytes that aren't what it reads.
BROKEN = (Refused, ValueError, struct.error, IndexError, KeyError, EOFError, StopIteration, RecursionError, lzma.LZMAError, zlib.error, OSError)


def _reader(name: str) -> Callable:
    """The reader of a kind; modules add theirs to ``READERS`` when they are imported."""
    from firmscope.sources import apk, archives, avb, bootparts, ext, vendor, x509  # noqa: F401

    return READERS[name]


def _parsed(name: str, parse: Callable, data) -> pa.RecordBatch:
    try:
        rows, error = [json.dumps(r) for r in parse(data)], None
    except BROKEN as x:
        rows, error = [None], f"{type(x).__name__}: {x}"
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array([error] * len(rows), pa.string())], ["path", "row", "error"])


def read(files: DataFrame, reader: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, row, error): one JSON row for each thing found, or one error row a file.

    Parse ``row`` with ``from_json`` and the schema wanted. files: path, content.
    """
    parse = _reader(reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield _parsed(name, parse, data.as_py() or b"")

    return files.select(path, content).mapInArrow(run, "path string, row string, error string")


def read_located(files: DataFrame, reader: str, path: str = "path", location: str = "location") -> DataFrame:
    """Like ``read``, but of files by their location: only the ranges that the reader
    asks for are fetched, so a file may have any size."""
    from firmscope.sources.remote import open_remote

    parse = _reader(reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _parsed(name, lambda w: parse(open_remote(w)), where)

    return files.select(path, location).mapInArrow(run, "path string, row string, error string")
