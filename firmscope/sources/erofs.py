"""erofs images: compact and extended inodes, plain, inline and chunked data, and LZ4
clusters with full or compact indexes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from firmscope.sources import lz4
from firmscope.sources.images import Refused
from firmscope.sources.tree import KINDS, MAX_FILE, XATTR_PREFIX, Tree, device

# fixed values: data layouts, cluster types, index bits and features of the format
PLAIN, FULL, INLINE, COMPACT, CHUNKED = range(5)
RAW, HEAD, BESIDE, HEAD2 = range(4)
BLOCK_COUNT = 0x800
SHORT_INDEX, BIG_1, BIG_2, INLINE_TAIL, INTERLACED, FRAGMENT = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
PADDED_FIRST, KNOWN_FEATURES = 0x1, 0x7F


class Erofs(Tree):
    """One file system over ``read_at(offset, size)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self._read, self.size = read_at, size
        s = self.bytes(1024, 128)
        if s[:4] != b"\xe2\xe1\xf5\xe0" or not 9 <= s[12] <= 16:
            raise Refused("no erofs superblock")
        self.bits, self.root = s[12], struct.unpack_from("<H", s, 14)[0]
        self.block = 1 << self.bits
        self.meta, self.shared = (struct.unpack_from("<I", s, k)[0] << self.bits for k in (40, 44))
        self.built = struct.unpack_from("<Q", s, 24)[0]
        self.features = struct.unpack_from("<I", s, 80)[0]
        if self.features & ~KNOWN_FEATURES:
            raise Refused("features that this reader doesn't know")

    def bytes(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise Refused(f"{n} bytes at {at} are outside of the image")
        return self._read(at, n)

    def inode(self, nid: int) -> dict:
        at = self.meta + 32 * nid
        head = self.bytes(at, 32)
        form, words, mode = struct.unpack_from("<HHH", head)
        if form & 1:
            head += self.bytes(at + 32, 32)
            size, number, _, uid, gid, mtime = struct.unpack_from("<QIIIIQ", head, 8)
            links = struct.unpack_from("<I", head, 44)[0]
        else:
            links, size, number = struct.unpack_from("<HI4xI", head, 6)
            uid, gid = struct.unpack_from("<HH", head, 24)
            mtime = self.built
        attributes = 12 + 4 * (words - 1) if words else 0
        return {"layout": form >> 1 & 7, "mode": mode, "size": size, "u": number, "uid": uid, "gid": gid, "mtime": mtime, "nlink": links, "xattr_at": at + len(head), "xattr_size": attributes, "end": at + len(head) + attributes}

    def data(self, inode: dict, nid: int) -> bytes:
        size, layout = inode["size"], inode["layout"]
        if size > MAX_FILE:
            raise Refused("the file is too large")
        if layout == PLAIN:
            return self.bytes(inode["u"] << self.bits, size)
        if layout == INLINE:
            front = max(-(-size // self.block) - 1, 0) * self.block
            return self.bytes(inode["u"] << self.bits, front) + self.bytes(inode["end"], size - front)
        if layout == CHUNKED:
            return b"".join(self._chunks(inode))
        if layout in (FULL, COMPACT):
            return b"".join(self._clusters(inode))
        raise Refused("unknown data layout")

    def _chunks(self, inode: dict) -> Iterator[bytes]:
        chunk, with_devices = self.block << (inode["u"] & 0x1F), inode["u"] & 0x20
        width = 8 if with_devices else 4
        at, n = (inode["end"] + width - 1) // width * width, -(-inode["size"] // chunk)
        for k in range(n):
            entry = self.bytes(at + width * k, width)
            if with_devices and struct.unpack_from("<H", entry, 2)[0]:
                raise Refused("the data lies on another device")
            where = struct.unpack("<I", entry[-4:])[0]
            left = min(chunk, inode["size"] - k * chunk)
            yield bytes(left) if where == 0xFFFFFFFF else self.bytes(where << self.bits, left)

    def _clusters(self, inode: dict) -> Iterator[bytes]:
        """The pieces of a compressed file, in order."""
        at = (inode["end"] + 7) // 8 * 8
        tail, advise, algorithms, bits = struct.unpack("<2xHHBB", self.bytes(at, 8))
        if advise & FRAGMENT or bits & 0x80:
            raise Refused("packed fragments can't be read")
        width = 1 << (self.bits + (bits & 7))
        n = -(-inode["size"] // width)
        index = self._full(at + 16, n) if inode["layout"] == FULL else self._compact(at + 8, n, advise, width.bit_length() - 1)
        heads: list[tuple[int, int, int, int]] = []  # (logical begin, block, blocks, type)
        for k, (kind, offset, where, count) in enumerate(index):
            if kind != BESIDE:
                if offset >= width:
                    raise Refused("a cluster begins outside")
                heads.append((k * width + offset, where, width >> self.bits if kind == RAW else 1, kind))
            elif count and heads and heads[-1][0] // width == k - 1:
                heads[-1] = (*heads[-1][:2], count, heads[-1][3])
        if inode["size"] and (not heads or heads[0][0]):
            raise Refused("the file begins in the middle of a cluster")
        for (begin, where, blocks, kind), (end, *_) in zip(heads, [*heads[1:], (inode["size"],)], strict=True):
            size = min(end, inode["size"]) - begin
            if size < 0:
                raise Refused("clusters are out of order")
            if advise & INLINE_TAIL and (begin, where) == heads[-1][:2] and tail:
                packed = self.bytes(at + 16 + 8 * n if inode["layout"] == FULL else self._compact_end(at + 8, n, advise), tail)
            else:
                packed = self.bytes(where << self.bits, max(blocks << self.bits, size) if kind == RAW else blocks << self.bits)
            if kind == RAW:
                turn = begin % self.block if advise & INTERLACED else 0
                yield (packed[turn : self.block] + packed[:turn])[:size] if turn else packed[:size]
            elif (algorithms >> (4 if kind == HEAD2 else 0)) & 15:
                raise Refused("only LZ4 clusters can be read")
            else:
                if self.features & PADDED_FIRST:
                    packed = packed.lstrip(b"\0")
                yield _first(packed, size)

    def _full(self, at: int, n: int) -> list[tuple[int, int, int, int]]:
        """(type, offset, block, blocks) of each cluster, from indexes of eight bytes."""
        out = []
        for k in range(n):
            kind, offset, where = struct.unpack("<HHI", self.bytes(at + 8 * k, 8))
            kind &= 3
            back = where & 0xFFFF
            out.append((kind, offset, where, back & ~BLOCK_COUNT if kind == BESIDE and back & BLOCK_COUNT else 0))
        return out

    @staticmethod
    def _parts(at: int, n: int, advise: int) -> tuple[int, int]:
        """How many indexes of four bytes come first, and how many of two bytes then."""
        first = (32 - at % 32) // 4 % 8
        return first, (n - first) // 16 * 16 if advise & SHORT_INDEX and first < n else 0

    def _compact_end(self, at: int, n: int, advise: int) -> int:
        first, short = self._parts(at, n, advise)
        return at + 4 * min(first, n) + 2 * short + (max(n - first - short, 0) + 1) // 2 * 8

    def _compact(self, at: int, n: int, advise: int, bits: int) -> list[tuple[int, int, int, int]]:
        """The same from packs of indexes, each with one block number at its end."""
        first, short = self._parts(at, n, advise)
        low, big = max(bits, 12), advise & (BIG_1 | BIG_2)
        out = []
        for k in range(n):
            if k < first:
                where, shift = at + 4 * k, 2
            elif k - first < short:
                where, shift = at + 4 * first + 2 * (k - first), 1
            else:
                where, shift = at + 4 * first + 2 * short + 4 * (k - first - short), 2
            count = 2 if shift == 2 else 16
            if shift == 2 and bits > 14 or shift == 1 and bits > 12:
                raise Refused("clusters too large for their indexes")
            size = count << shift
            begin = where // size * size
            pack = self.bytes(begin, size)
            number, each, i = int.from_bytes(pack, "little"), (size - 4) * 8 // count, (where - begin) >> shift
            read = lambda j: (number >> each * j >> low & 3, number >> each * j & ((1 << low) - 1))  # noqa: B023, E731
            kind, value = read(i)
            if kind == BESIDE:
                out.append((kind, 0, 0, value & ~BLOCK_COUNT if value & BLOCK_COUNT else 0))
                continue
            before, j = 0 if big else 1, i
            while j > 0:
                j -= 1
                t, v = read(j)
                if not big:
                    j -= v if t == BESIDE else 0
                    before += j >= 0
                elif t != BESIDE:
                    before += 1
                elif v & BLOCK_COUNT:
                    j -= 1
                    before += v & ~BLOCK_COUNT
                elif v <= 1:
                    raise Refused("a broken pack of indexes")
                else:
                    j -= v - 2
            out.append((kind, value, struct.unpack_from("<I", pack, size - 4)[0] + before, 0))
        return out

    def children(self, inode: dict, nid: int) -> dict[str, int]:
        data, out = self.data(inode, nid), {}
        for at in range(0, len(data), self.block):
            area = data[at : at + self.block]
            if len(area) < 12:
                raise Refused("broken directory")
            first = struct.unpack_from("<H", area, 8)[0]
            if first % 12 or not 12 <= first <= len(area):
                raise Refused("broken directory")
            rows = [struct.unpack_from("<QH", area, 12 * k) for k in range(first // 12)]
            for k, (child, begin) in enumerate(rows):
                end = rows[k + 1][1] if k + 1 < len(rows) else len(area)
                if not first <= begin <= end <= len(area):
                    raise Refused("broken directory")
                name = area[begin:end].split(b"\0")[0].decode("utf-8", "backslashreplace")
                if name not in (".", ".."):
                    if not name or "/" in name:
                        raise Refused("a broken name")
                    out[name] = child
        return out

    def xattrs(self, inode: dict) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if not inode["xattr_size"]:
            return out
        area = self.bytes(inode["xattr_at"], inode["xattr_size"])
        count = area[4]
        at = 12 + 4 * count
        if at > len(area):
            raise Refused("attributes reach outside")

        def one(head: bytes, body: Callable[[int, int], bytes]) -> int:
            n, space, size = struct.unpack("<BBH", head)
            if space & 0x80:
                raise Refused("long attribute prefixes can't be read")
            out[XATTR_PREFIX.get(space, "") + body(4, n).decode("utf-8", "replace")] = body(4 + n, size)
            return (4 + n + size + 3) // 4 * 4

        while at + 4 <= len(area) and any(area[at : at + 4]):
            part = area[at:]
            if 4 + part[0] + struct.unpack_from("<H", part, 2)[0] > len(part):
                raise Refused("an attribute reaches outside")
            at += one(part[:4], lambda x, n, part=part: part[x : x + n])
        for k in range(count):
            where = self.shared + 4 * struct.unpack_from("<I", area, 12 + 4 * k)[0]
            one(self.bytes(where, 4), lambda x, n, where=where: self.bytes(where + x, n))
        return out

    def entry(self, path: str, nid: int, inode: dict) -> dict:
        kind = KINDS.get(inode["mode"] >> 12)
        if kind is None:
            raise Refused(f"{path} has an unknown kind")
        if kind == "symlink" and inode["size"] > 4096:
            raise Refused(f"{path} has a target that is too long")
        link = self.data(inode, nid).decode("utf-8", "backslashreplace") if kind == "symlink" else None
        rdev = device(0, inode["u"]) if kind in ("char", "block") else None
        return {
            "path": path, "kind": kind, "mode": inode["mode"] & 0o7777, "uid": inode["uid"], "gid": inode["gid"], "size": inode["size"] if kind == "file" else 0, "mtime": inode["mtime"], "ino": nid, "nlink": inode["nlink"], "link": link, "rdev": rdev,
            "xattrs": [(k, v.rstrip(b"\0").decode("utf-8", "backslashreplace")) for k, v in sorted(self.xattrs(inode).items())],
        }


def _first(packed: bytes, size: int) -> bytes:
    """The first ``size`` bytes of an LZ4 block, whose end may be padding."""
    out = lz4.block(packed, size, stop=True)
    if len(out) != size:
        raise Refused("a cluster has the wrong size")
    return bytes(out)
