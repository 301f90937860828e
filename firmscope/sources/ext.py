"""File systems of images (ext2, ext3, ext4; erofs and f2fs beside them): entries without file data, and file data on demand.

The reader seeks in the image by block and never loads it whole, so images may
be larger than any buffer. Entries come first; contents are read only for the
paths that a later plan asks for.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from firmscope.operators.schema import ENTRY
from firmscope.sources.images import Refused
from firmscope.sources.remote import open_remote
from firmscope.sources.tree import KINDS, MAX_DEPTH, MAX_ENTRIES, MAX_FILE, XATTR_PREFIX, Tree, device

_EXTENTS, _INLINE = 0x80000, 0x10000000
_64BIT, _META_BG, _FILETYPE = 0x80, 0x10, 0x2


class Image(Tree):
    """One ext file system over ``read_at(offset, size)``."""

    root = 2

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self._read, self.size = read_at, size
        s = self.bytes(1024, 1024)
        if s[0x38:0x3A] != b"\x53\xef":
            raise Refused("no ext superblock")
        self.n_inodes, self.n_blocks = struct.unpack_from("<II", s)
        first, log = struct.unpack_from("<II", s, 0x14)
        if log > 6:
            raise Refused("bad block size")
        self.block = 1024 << log
        self.per_group = struct.unpack_from("<I", s, 0x28)[0]
        dynamic = struct.unpack_from("<I", s, 0x4C)[0] >= 1
        self.inode_size = struct.unpack_from("<H", s, 0x58)[0] if dynamic else 128
        self.incompat = struct.unpack_from("<I", s, 0x60)[0] if dynamic else 0
        if self.incompat & _META_BG or not self.per_group or not 128 <= self.inode_size <= self.block:
            raise Refused("layout that this reader doesn't know")
        self.wide = bool(self.incompat & _64BIT)
        self.desc_size = max(32, struct.unpack_from("<H", s, 0xFE)[0]) if self.wide else 32
        self.desc_at = (first + 1) * self.block

    def bytes(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise Refused(f"{n} bytes at {at} are outside of the image")
        out = self._read(at, n)
        if len(out) != n:
            raise Refused("the image ends early")
        return out

    def inode(self, ino: int) -> bytes:
        if not 1 <= ino <= self.n_inodes:
            raise Refused(f"inode {ino} doesn't exist")
        group, k = divmod(ino - 1, self.per_group)
        d = self.bytes(self.desc_at + group * self.desc_size, self.desc_size)
        table = struct.unpack_from("<I", d, 8)[0]
        if self.wide and self.desc_size >= 64:
            table |= struct.unpack_from("<I", d, 0x28)[0] << 32
        return self.bytes(table * self.block + k * self.inode_size, self.inode_size)

    def _extents(self, node: bytes, depth: int = 0) -> Iterator[tuple[int, int, int]]:
        """(first file block, count, first disk block or 0 for zeros)."""
        magic, n, _, level = struct.unpack_from("<HHHH", node)
        if magic != 0xF30A or depth > 5 or 12 + 12 * n > len(node):
            raise Refused("broken extent tree")
        for k in range(n):
            if level:
                _, low, high = struct.unpack_from("<IIH", node, 12 + 12 * k)
                yield from self._extents(self.bytes((low | high << 32) * self.block, self.block), depth + 1)
            else:
                at, count, high, low = struct.unpack_from("<IHHI", node, 12 + 12 * k)
                yield (at, count - 32768, 0) if count > 32768 else (at, count, low | high << 32)

    def _mapped(self, node: bytes, n: int) -> Iterator[tuple[int, int, int]]:
        """The same for block maps: twelve direct blocks, then one to three levels."""
        fan = self.block // 4

        def below(block: int, level: int, at: int) -> Iterator[tuple[int, int, int]]:
            if at >= n:
                return
            if not level:
                yield at, 1, block
            elif block:
                for k, b in enumerate(struct.unpack(f"<{fan}I", self.bytes(block * self.block, self.block))):
                    yield from below(b, level - 1, at + k * fan ** (level - 1))

        at = 0
        for k, b in enumerate(struct.unpack_from("<15I", node)):
            level = max(0, k - 11)
            yield from below(b, level, at)
            at += fan**level

    def data(self, inode: bytes, ino: int) -> bytes:
        size, flags = self.file_size(inode), struct.unpack_from("<I", inode, 0x20)[0]
        if size > MAX_FILE:
            raise Refused(f"inode {ino} is too large to read at once")
        if flags & _INLINE:
            return (inode[0x28:0x64] + self.xattrs(inode).get("system.data", b""))[:size]
        n = -(-size // self.block)
        out = bytearray(size)
        node = inode[0x28:0x64]
        for at, count, disk in self._extents(node) if flags & _EXTENTS else self._mapped(node, n):
            if disk and at < n:
                take = min(count, n - at) * self.block
                piece = self.bytes(disk * self.block, take)[: size - at * self.block]
                out[at * self.block : at * self.block + len(piece)] = piece
        return bytes(out)

    @staticmethod
    def file_size(inode: bytes) -> int:
        return struct.unpack_from("<I", inode, 4)[0] | struct.unpack_from("<I", inode, 0x6C)[0] << 32

    def xattrs(self, inode: bytes) -> dict[str, bytes]:
        out: dict[str, bytes] = {}

        def entries(area: bytes, at: int, base: int) -> None:
            while at + 16 <= len(area) and area[at]:
                n, space, offset, _, size, _ = struct.unpack_from("<BBHIII", area, at)
                name = XATTR_PREFIX.get(space, "") + area[at + 16 : at + 16 + n].decode("utf-8", "replace")
                if base + offset + size > len(area):
                    raise Refused("an attribute reaches outside")
                out[name] = area[base + offset : base + offset + size]
                at += (16 + n + 3) // 4 * 4

        if self.inode_size > 130:
            start = 128 + struct.unpack_from("<H", inode, 128)[0]
            if start + 4 <= len(inode) and struct.unpack_from("<I", inode, start)[0] == 0xEA020000:
                entries(inode[start + 4 :], 0, 0)
        acl = struct.unpack_from("<I", inode, 0x68)[0] | (struct.unpack_from("<H", inode, 0x76)[0] << 32 if self.wide else 0)
        if acl:
            area = self.bytes(acl * self.block, self.block)
            if struct.unpack_from("<I", area)[0] == 0xEA020000:
                entries(area, 32, 0)
        return out

    def children(self, inode: bytes, ino: int) -> dict[str, int]:
        data = self.data(inode, ino)
        out: dict[str, int] = {}
        areas = [data]
        if struct.unpack_from("<I", inode, 0x20)[0] & _INLINE:
            areas = [data[4:60], data[60:]]
        for area in areas:
            at = 0
            while at + 8 <= len(area):
                child, length, n = struct.unpack_from("<IHB", area, at)
                if not self.incompat & _FILETYPE:
                    n = struct.unpack_from("<H", area, at + 6)[0]
                if length < 8 or at + length > len(area) or n > length - 8:
                    raise Refused("broken directory")
                name = area[at + 8 : at + 8 + n].decode("utf-8", "backslashreplace")
                if child and name not in (".", ".."):
                    if "/" in name or "\0" in name:
                        raise Refused("a name with a slash")
                    out[name] = child
                at += length
        return out

    def entry(self, path: str, ino: int, inode: bytes) -> dict:
        mode, uid = struct.unpack_from("<HH", inode)
        mtime, gid, links = struct.unpack_from("<i", inode, 0x10)[0], *struct.unpack_from("<HH", inode, 0x18)
        kind = KINDS.get(mode >> 12)
        if kind is None:
            raise Refused(f"{path} has an unknown kind")
        link = rdev = None
        if kind == "symlink":
            size, flags = self.file_size(inode), struct.unpack_from("<I", inode, 0x20)[0]
            inner = size < 60 and not flags & (_EXTENTS | _INLINE)
            link = (inode[0x28 : 0x28 + size] if inner else self.data(inode, ino)).decode("utf-8", "backslashreplace")
        elif kind in ("char", "block"):
            old, new = struct.unpack_from("<II", inode, 0x28)
            rdev = device(old, new)
        return {
            "path": path, "kind": kind, "mode": mode & 0o7777, "uid": uid | struct.unpack_from("<H", inode, 0x78)[0] << 16, "gid": gid | struct.unpack_from("<H", inode, 0x7A)[0] << 16, "size": self.file_size(inode),
            "mtime": mtime, "ino": ino, "nlink": links, "link": link, "rdev": rdev, "xattrs": [(k, v.rstrip(b"\0").decode("utf-8", "backslashreplace")) for k, v in self.xattrs(inode).items() if k != "system.data"],
        }


def open_image(path: str) -> Tree:
    """The file system of an image, by its superblock."""
    from firmscope.sources.erofs import Erofs
    from firmscope.sources.f2fs import F2fs

    f = open_remote(path)
    head = f[1024:1028]
    kind = F2fs if head == b"\x10\x20\xf5\xf2" else Erofs if head == b"\xe2\xe1\xf5\xe0" else Image
    return kind(lambda at, n: f[at : at + n], len(f))


def read_entries(images: DataFrame) -> DataFrame:
    """Entries (``ENTRY`` plus ``error``) of images (columns image, location); an image
    that can't be read gives one row with its error."""
    schema = f"{ENTRY}, error string"
    names = [c.strip().split(" ")[0] for c in "image, path, kind, mode, uid, gid, size, mtime, ino, nlink, link, rdev, xattrs, sha256, extracted_as, error".split(",")]
    types = pa.schema([("image", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), *[(c, pa.int64()) for c in ("uid", "gid", "size", "mtime", "ino", "nlink")], ("link", pa.string()), ("rdev", pa.struct([("major", pa.int64()), ("minor", pa.int64())])), ("xattrs", pa.map_(pa.string(), pa.string())), ("sha256", pa.string()), ("extracted_as", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, location in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [dict.fromkeys(names) | e | {"image": image} for e in open_image(location).walk()]
                except (Refused, OSError, ValueError, struct.error) as x:
                    rows = [dict.fromkeys(names) | {"image": image, "error": str(x)}]
                yield pa.RecordBatch.from_pylist(rows, types)

    return images.select("image", "location").mapInArrow(run, schema)


def read_contents(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """(image, path, content, sha256, error) of the wanted (image, path) rows only."""
    jobs = wanted.select("image", "path").join(images.select("image", "location"), "image").select("image", "location", "path")
    types = pa.schema([("image", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("sha256", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Image] = {}
        for b in batches:
            for image, location, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    if location not in open_:
                        open_.clear()
                        open_[location] = open_image(location)
                    ino, inode = open_[location].find(path)
                    data = open_[location].data(inode, ino)
                    row = (image, path, data, hashlib.sha256(data).hexdigest(), None)
                except (Refused, OSError, ValueError, struct.error) as x:
                    row = (image, path, None, None, str(x))
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, row, strict=True))], types)

    return jobs.sortWithinPartitions("location").mapInArrow(run, "image string, path string, content binary, sha256 string, error string")
