"""f2fs images: the newer checkpoint, node addresses through its journal, inline data."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from firmscope.sources.images import Refused
from firmscope.sources.tree import KINDS, MAX_FILE, XATTR_PREFIX, Tree, device

# fixed values: layout of the format
BLOCK, PER_SEGMENT, NAT_PER_BLOCK, ADDRESSES, INODE_ADDRESSES, ADDRESS_AT, NIDS_AT = 4096, 512, 455, 1018, 923, 360, 4052
UMOUNT, COMPACT_SUMMARY, LARGE_NAT_BITMAP = 0x1, 0x4, 0x400
INLINE_XATTR, INLINE_DATA, INLINE_DENTRY, EXTRA_ATTR = 0x1, 0x2, 0x4, 0x20
FLEXIBLE_XATTR, CHECKED, REFUSED_FEATURES, KNOWN_FEATURES = 0x40, 0x800, 0x2 | 0x8000, 0x3FFFF
ENCRYPTED, COMPRESSED = 0x4, 0x4
XATTR_MAGIC = 0xF2F52011


def checksum(data: bytes) -> int:
    """The format's CRC-32: it starts from the magic number and isn't inverted."""
    return zlib.crc32(data, 0xF2F52010 ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def _bit(bitmap: bytes, k: int) -> bool:
    return k >> 3 < len(bitmap) and bool(bitmap[k >> 3] >> (7 - (k & 7)) & 1)


class F2fs(Tree):
    """One file system over ``read_at(offset, size)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self._read, self.size = read_at, size
        s = self.bytes(1024, 3072)
        features = struct.unpack_from("<I", s, 2180)[0]
        if s[:4] != b"\x10\x20\xf5\xf2" or features & REFUSED_FEATURES or features & ~KNOWN_FEATURES:
            raise Refused("no f2fs superblock that this reader knows")
        if features & CHECKED:
            at = struct.unpack_from("<I", s, 32)[0]
            if not 4 <= at <= 3068 or checksum(s[:at]) != struct.unpack_from("<I", s, at)[0]:
                raise Refused("the superblock's checksum is wrong")
        sector, per_block, block, segment = struct.unpack_from("<4I", s, 8)
        if block != 12 or segment != 9 or not 9 <= sector <= 12 or per_block != 12 - sector:
            raise Refused("unknown block sizes")
        if any(struct.unpack_from("<I", s, 2201 + 68 * k + 64)[0] for k in range(8)):
            raise Refused("volumes over several devices can't be read")
        self.flexible = bool(features & FLEXIBLE_XATTR)
        self.blocks = struct.unpack_from("<Q", s, 36)[0]
        _, _, nat_segments = struct.unpack_from("<3I", s, 52)
        checkpoint, _, self.nat_at, _, self.main_at, self.root = struct.unpack_from("<6I", s, 76)
        self.most_nodes = nat_segments // 2 * PER_SEGMENT * NAT_PER_BLOCK
        payload = struct.unpack_from("<I", s, 1664)[0]
        packs = [p for p in (self._pack(checkpoint, payload), self._pack(checkpoint + PER_SEGMENT, payload)) if p]
        if not packs:
            raise Refused("no checkpoint is valid")
        _, self.bitmap, self.journal = max(packs, key=lambda p: p[0])
        self._nodes: dict[int, bytes] = {}

    def bytes(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise Refused(f"{n} bytes at {at} are outside of the image")
        return self._read(at, n)

    def block(self, k: int) -> bytes:
        return self.bytes(k * BLOCK, BLOCK)

    def _pack(self, at: int, payload: int) -> tuple[int, bytes, dict[int, int]] | None:
        """(version, bitmap of node tables, journal) of a checkpoint whose two ends agree."""
        try:
            first = self.block(at)
            total, begin = struct.unpack_from("<II", first, 136)
            last = self.block(at + total - 1)
            for b in (first, last):
                where = struct.unpack_from("<I", b, 164)[0]
                if not 192 <= where <= BLOCK - 4 or checksum(b[:where]) != struct.unpack_from("<I", b, where)[0]:
                    return None
            if first[:8] != last[:8] or not 2 < total <= PER_SEGMENT:
                return None
            flags = struct.unpack_from("<I", first, 132)[0]
            sit, nat = struct.unpack_from("<II", first, 156)
            start = 196 if flags & LARGE_NAT_BITMAP else 192 if payload else 192 + sit
            if start + nat > BLOCK:
                return None
            if flags & COMPACT_SUMMARY:
                journal = self.block(at + begin)
            else:
                journal = self.block(at + total - (7 if flags & UMOUNT else 4))[3584:]
            n = struct.unpack_from("<H", journal)[0]
            if n > 38:
                return None
            return struct.unpack_from("<Q", first)[0], first[start : start + nat], dict(struct.unpack_from("<I5xI", journal, 2 + 13 * k) for k in range(n))
        except Refused:
            return None

    def inode(self, nid: int) -> bytes:
        """A node's block, through the journal or the node table."""
        if nid in self._nodes:
            return self._nodes[nid]
        if not 0 < nid < self.most_nodes:
            raise Refused(f"node {nid} doesn't exist")
        where = self.journal.get(nid)
        if where is None:
            k = nid // NAT_PER_BLOCK
            table = self.nat_at + 2 * k - k % PER_SEGMENT + (PER_SEGMENT if _bit(self.bitmap, k) else 0)
            where = struct.unpack_from("<5xI", self.block(table), nid % NAT_PER_BLOCK * 9)[0]
        if not self.main_at <= where < self.blocks:
            raise Refused(f"node {nid} has no place")
        node = self.block(where)
        if struct.unpack_from("<I", node, 4072)[0] != nid:
            raise Refused(f"node {nid} is another one")
        if len(self._nodes) > 4096:
            self._nodes.clear()
        self._nodes[nid] = node
        return node

    def _shape(self, node: bytes) -> tuple[int, int, int]:
        """(where the addresses begin, how many there are, words of inline attributes)."""
        extra = struct.unpack_from("<H", node, ADDRESS_AT)[0] if node[3] & EXTRA_ATTR else 0
        if extra % 4 or extra >= INODE_ADDRESSES * 2:
            raise Refused("bad extra attributes")
        words = 0
        if node[3] & INLINE_XATTR:
            words = struct.unpack_from("<H", node, ADDRESS_AT + 2)[0] if extra >= 4 and self.flexible else 50
        count = INODE_ADDRESSES - extra // 4 - words
        if count < 2:
            raise Refused("bad inline attributes")
        return ADDRESS_AT + extra, count, words

    @staticmethod
    def file_size(node: bytes) -> int:
        return struct.unpack_from("<Q", node, 16)[0]

    def _addresses(self, node: bytes, n: int) -> list[int]:
        """Block addresses of a file's first n blocks; 0 for holes."""
        at, count, _ = self._shape(node)
        out = list(struct.unpack_from(f"<{count}I", node, at))
        empty = [0] * ADDRESSES
        direct = lambda nid: list(struct.unpack_from(f"<{ADDRESSES}I", self.inode(nid))) if nid else empty

        def tree(nid: int, depth: int) -> None:
            if len(out) >= n:
                return
            if depth == 0:
                out.extend(direct(nid))
            elif nid:
                for inner in direct(nid):
                    tree(inner, depth - 1)
            else:
                out.extend([0] * min(ADDRESSES ** (depth + 1), n - len(out)))

        for nid, depth in zip(struct.unpack_from("<5I", node, NIDS_AT), (0, 0, 1, 1, 2), strict=True):
            tree(nid, depth)
        return out[:n]

    def data(self, node: bytes, nid: int) -> bytes:
        size = self.file_size(node)
        if size > MAX_FILE:
            raise Refused("the file is too large")
        if node[2] & ENCRYPTED:
            raise Refused("the contents are encrypted")
        at, count, _ = self._shape(node)
        if node[3] & INLINE_DATA:
            if size > (count - 1) * 4:
                raise Refused("inline data is too long")
            return node[at + 4 : at + 4 + size]
        if struct.unpack_from("<I", node, 80)[0] & COMPRESSED:
            raise Refused("the contents are compressed")
        out = []
        for where in self._addresses(node, -(-size // BLOCK)):
            if where in (0, 0xFFFFFFFF):
                out.append(bytes(BLOCK))
            elif self.main_at <= where < self.blocks:
                out.append(self.block(where))
            else:
                raise Refused("a block lies outside")
        return b"".join(out)[:size]

    def children(self, node: bytes, nid: int) -> dict[str, int]:
        if node[2] & ENCRYPTED:
            raise Refused("the names are encrypted")
        areas: list[tuple[bytes, int, int]] = []
        if node[3] & INLINE_DENTRY:
            at, count, _ = self._shape(node)
            room = (count - 1) * 4
            n = room * 8 // 153
            areas.append((node[at + 4 : at + 4 + room], n, room - 19 * n))
        else:
            data = self.data(node, nid)
            areas = [(data[k : k + BLOCK], 214, 30) for k in range(0, len(data) // BLOCK * BLOCK, BLOCK)]
        out: dict[str, int] = {}
        for area, n, first in areas:
            k = 0
            while k < n:
                if not area[k >> 3] >> (k & 7) & 1:
                    k += 1
                    continue
                child, length = struct.unpack_from("<4xIH", area, first + 11 * k)
                at = first + 11 * n + 8 * k
                if not length or length > 255 or at + length > len(area):
                    raise Refused("a broken name")
                name = area[at : at + length].decode("utf-8", "backslashreplace")
                if name not in (".", ".."):
                    if "/" in name or "\0" in name:
                        raise Refused("a name with a slash")
                    out[name] = child
                k += -(-length // 8)
        return out

    def xattrs(self, node: bytes) -> dict[str, bytes]:
        _, _, words = self._shape(node)
        end = ADDRESS_AT + 4 * INODE_ADDRESSES
        area, more = node[end - 4 * words : end], struct.unpack_from("<I", node, 76)[0]
        if more:
            area += self.inode(more)[:4072]
        out: dict[str, bytes] = {}
        if len(area) < 24 or struct.unpack_from("<I", area)[0] != XATTR_MAGIC:
            return out
        at = 24
        while at + 4 <= len(area) and any(area[at : at + 4]):
            space, n, size = struct.unpack_from("<BBH", area, at)
            if at + 4 + n + size > len(area):
                raise Refused("an attribute reaches outside")
            out[XATTR_PREFIX.get(space, "") + area[at + 4 : at + 4 + n].decode("utf-8", "replace")] = area[at + 4 + n : at + 4 + n + size]
            at += (4 + n + size + 3) // 4 * 4
        return out

    def entry(self, path: str, nid: int, node: bytes) -> dict:
        mode, uid, gid, links, size = struct.unpack_from("<H2xIIIQ", node)
        kind = KINDS.get(mode >> 12)
        if kind is None:
            raise Refused(f"{path} has an unknown kind")
        link = self.data(node, nid).decode("utf-8", "backslashreplace") if kind == "symlink" and not node[2] & ENCRYPTED else None
        rdev = device(*struct.unpack_from("<II", node, self._shape(node)[0])) if kind in ("char", "block") else None
        return {
            "path": path, "kind": kind, "mode": mode & 0o7777, "uid": uid, "gid": gid, "size": size, "mtime": struct.unpack_from("<q", node, 48)[0], "ino": nid, "nlink": links, "link": link, "rdev": rdev,
            "xattrs": [(k, v.rstrip(b"\0").decode("utf-8", "backslashreplace")) for k, v in self.xattrs(node).items()],
        }
