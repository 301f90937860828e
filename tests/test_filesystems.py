"""erofs and f2fs images that are laid out here, by the format's rules."""

import random
import struct

import pytest

from firmscope.sources import ext, f2fs
from firmscope.sources.erofs import Erofs
from firmscope.sources.f2fs import F2fs
from firmscope.sources.images import BROKEN, Refused

R = random.Random(9)
NOISE = bytes(R.randrange(256) for _ in range(100_000))
BLOCK = 4096


def run_of(pair, size):
    """LZ4 data of a pair that repeats."""
    left = size - 2 - 4 - 15
    return b"\x2f" + pair + b"\x02\x00" + b"\xff" * (left // 255) + bytes([left % 255])


def erofs_image(padded=True):
    image = bytearray(BLOCK * 120)
    struct.pack_into("<IIIBBHQQIIII", image, 1024, 0xE0F5E1E2, 0, 0, 12, 0, 2, 0, 77, 0, 120, 1, 100)
    struct.pack_into("<I", image, 1024 + 80, 1 if padded else 0)
    at = {"slot": 2, "block": 10}

    def blocks(data):
        n = at["block"]
        image[n * BLOCK : n * BLOCK + len(data)] = data
        at["block"] += -(-len(data) // BLOCK)
        return n

    def inode(mode, layout, size, u=0, xattrs=b"", tail=b"", links=1, compact=False, nid=None):
        if nid is None:
            nid = at["slot"]
            room = (32 if compact else 64) + len(xattrs) + len(tail) + 24
            at["slot"] += -(-room // 32)
        where, words = BLOCK + 32 * nid, (len(xattrs) - 12) // 4 + 1 if xattrs else 0
        if compact:
            head = struct.pack("<HHHHIIIIHHI", layout << 1, words, mode, links, size, 0, u, nid, 1000, 2000, 0)
        else:
            head = struct.pack("<HHHHQIIIIQII16x", layout << 1 | 1, words, mode, 0, size, u, nid, 1000, 2000, 1234, 0, links)
        image[where : where + len(head) + len(xattrs) + len(tail)] = head + xattrs + tail
        return nid

    at["slot"] = 4 + 2  # the root is in slot 2, with room for an extended inode
    shared = struct.pack("<BBH", 7, 6, 3) + b"selinux" + b"abc"
    image[100 * BLOCK + 8 : 100 * BLOCK + 8 + len(shared)] = shared
    xattrs = struct.pack("<IB7xI", 0, 1, 2) + struct.pack("<BBH", 3, 1, 2) + b"foo" + b"hi" + bytes(3)
    wanted = {}

    def file(name, data, nid):
        wanted[name] = (nid, data)

    file("plain", NOISE[:9000], inode(0o100644, 0, 9000, blocks(NOISE[:9000])))
    file("inline", b"hello", inode(0o100755, 2, 5, 0, xattrs, b"hello", links=2))
    file("tail", NOISE[:5000], inode(0o100600, 2, 5000, blocks(NOISE[:4096]), tail=NOISE[4096:5000], compact=True))
    chunks = struct.pack("<II", blocks(NOISE[:8192]), 0xFFFFFFFF)
    file("chunks", NOISE[:8192] + bytes(100), inode(0o100644, 4, 8292, 1, tail=chunks, compact=True))
    # Two clusters: one of LZ4 data for 10,000 bytes, one of 4,000 plain bytes.
    text = b"ab" * 5000 + NOISE[:4000]
    packed = run_of(b"ab", 10000)
    a = blocks(packed.rjust(BLOCK, b"\0") if padded else packed)
    b = blocks(NOISE[:4000])

    def align(slot, compact, data):
        end = BLOCK + 32 * slot + (32 if compact else 64)
        return bytes(-end % 8) + data

    header = struct.pack("<IHBB", 0, 0, 0, 0)
    full = header + bytes(8) + struct.pack("<HHI", 1, 0, a) + struct.pack("<HHHH", 2, 0, 1, 1) + struct.pack("<HHI", 0, 1808, b) + struct.pack("<HHHH", 2, 0, 1, 1)
    file("full", text, inode(0o100644, 1, 14000, 2, tail=align(at["slot"], False, full)))
    pack = lambda one, two, where: struct.pack("<HHI", one[0] << 12 | one[1], two[0] << 12 | two[1], where)
    short = header + pack((1, 0), (2, 1), a - 1) + pack((0, 1808), (2, 1), b - 1)
    file("packs", text, inode(0o100644, 3, 14000, 2, tail=align(at["slot"], False, short)))
    # Twenty-four plain clusters, most of their indexes in a pack of sixteen.
    data = NOISE[: 23 * BLOCK + 50]
    first = blocks(data)
    start = BLOCK + 32 * at["slot"] + 64 + 8
    four = (32 - start % 32) // 4 % 8
    index, k = b"", 0
    while k < 24:
        if k == four:
            index += (sum(0 << 14 * j for j in range(16)) | (first + k - 1) << 224).to_bytes(32, "little")
            k += 16
        else:
            index += pack((0, 0), (0, 0), first + k - 1)
            k += 2
    file("sixteen", data, inode(0o100644, 3, len(data), 24, tail=struct.pack("<IHBB", 0, 1, 0, 0) + index))
    link = inode(0o120777, 2, 6, tail=b"target")
    node = inode(0o020600, 0, 0, 5 << 8 | 3)

    def folder(rows):
        rows = sorted(rows)
        names, out = b"", b""
        for name, nid in rows:
            out += struct.pack("<QHBB", nid, 12 * len(rows) + len(names), 0, 0)
            names += name.encode()
        return out + names

    sub_data = folder([(".", 0), ("..", 2), ("deep", wanted["plain"][0])])
    sub = inode(0o040755, 2, len(sub_data), tail=sub_data)
    root = folder([(".", 2), ("..", 2), ("link", link), ("node", node), ("sub", sub), *[(n, i) for n, (i, _) in wanted.items()]])
    inode(0o040755, 0, len(root), blocks(root), nid=2)
    return bytes(image), {n: d for n, (_, d) in wanted.items()}


@pytest.mark.parametrize("padded", [True, False])
def test_erofs(padded):
    image, wanted = erofs_image(padded)
    fs = Erofs(lambda at, n: image[at : at + n], len(image))
    entries = {e["path"]: e for e in fs.walk()}
    assert set(entries) == {"link", "node", "sub", "sub/deep", *wanted}
    for name, data in wanted.items():
        nid, inode = fs.find(name)
        assert fs.data(inode, nid) == data and entries[name]["size"] == len(data), name
    e = entries["inline"]
    assert (e["mode"], e["uid"], e["gid"], e["nlink"], e["mtime"]) == (0o755, 1000, 2000, 2, 1234) and entries["tail"]["mtime"] == 77
    assert e["xattrs"] == [("security.selinux", "abc"), ("user.foo", "hi")]
    assert entries["link"]["link"] == "target" and entries["node"]["rdev"] == {"major": 5, "minor": 3} and entries["sub/deep"]["size"] == 9000
    with pytest.raises(Refused):
        fs.find("sub/nothing")
    for n in range(1024, len(image), 9001):
        short = image[:n]
        with pytest.raises(BROKEN):
            fs = Erofs(lambda at, k, s=short: s[at : at + k], n)
            for e in fs.walk():
                fs.data(*reversed(fs.find(e["path"])))
            raise Refused("read to the end")


def f2fs_image():
    image = bytearray(BLOCK * 2700)
    checkpoint, nat, main, root = 512, 1536, 2560, 3
    s = bytearray(3072)
    s[:4] = b"\x10\x20\xf5\xf2"
    struct.pack_into("<6I", s, 8, 9, 3, 12, 9, 1, 1)
    struct.pack_into("<Q", s, 36, 2700)
    struct.pack_into("<5I", s, 52, 2, 2, 2, 1, 1)
    struct.pack_into("<8I", s, 76, checkpoint, 1100, nat, 2500, main, root, 1, 2)
    struct.pack_into("<I", s, 2180, 0x800)
    struct.pack_into("<I", s, 32, 3068)
    struct.pack_into("<I", s, 3068, f2fs.checksum(bytes(s[:3068])))
    image[1024:4096] = s
    at = [main]

    def put(data):
        image[at[0] * BLOCK : at[0] * BLOCK + len(data)] = data
        at[0] += 1
        return at[0] - 1

    places = {}

    def node(nid, mode, size, inline=0, addresses=(), nids=(), area=None, xattr=b"", links=1, more=0):
        b = bytearray(BLOCK)
        struct.pack_into("<HBBIIIQ", b, 0, mode, 0, inline, 10, 20, links, size)
        struct.pack_into("<q", b, 48, 99)
        struct.pack_into("<I", b, 76, more)
        if area is not None:
            b[364 : 364 + len(area)] = area
        for k, a in enumerate(addresses):
            struct.pack_into("<I", b, 360 + 4 * k, a)
        if xattr:
            b[4052 - 200 : 4052 - 200 + len(xattr)] = xattr
        for k, x in enumerate(nids):
            struct.pack_into("<I", b, 4052 + 4 * k, x)
        struct.pack_into("<II", b, 4072, nid, nid)
        places[nid] = put(b)

    def names(rows, n, first, size):
        area, slot = bytearray(size), 0
        for name, nid in rows:
            raw = name.encode()
            struct.pack_into("<IIHB", area, first + 11 * slot, 0, nid, len(raw), 1)
            area[first + 11 * n + 8 * slot : first + 11 * n + 8 * slot + len(raw)] = raw
            for k in range(-(-len(raw) // 8)):
                area[slot >> 3] |= 1 << (slot & 7)
                slot += 1
        return bytes(area)

    label = struct.pack("<II16x", 0xF2F52011, 1) + struct.pack("<BBH", 6, 7, 4) + b"selinux" + b"u:r\0" + bytes(5)
    node(4, 0o100644, 11, 2 | 1, area=b"inline text", xattr=label)
    node(5, 0o100600, 9000, addresses=[put(NOISE[:4096]), 0, put(NOISE[8192:9000])])
    old_place = places[5]
    node(5, 0o100600, 9000, addresses=[put(NOISE[:4096]), 0, put(NOISE[8192:9000])])
    new_place, places[5] = places[5], 1  # only the journal knows it
    node(6, 0o120777, 6, 2, area=b"target")
    room = (923 - 1) * 4
    n = room * 8 // 153
    node(7, 0o040755, room, 4, area=names([(".", 7), ("..", 3), ("a name of more than eight", 5)], n, room - 19 * n, room))
    direct = bytearray(BLOCK)
    struct.pack_into("<I", direct, 4 * 2, put(b"far"))
    struct.pack_into("<II", direct, 4072, 9, 8)
    places[9] = put(direct)
    node(8, 0o100644, 926 * BLOCK, nids=[9])
    node(10, 0o060600, 0, addresses=[0, 259 << 8 | 7])
    node(3, 0o040755, BLOCK, addresses=[put(names([(".", 3), ("..", 3), ("inl", 4), ("dir", 7), ("link", 6), ("holes", 5), ("big", 8), ("dev", 10)], 214, 30, BLOCK))], links=3)
    table = bytearray(BLOCK)
    for nid, where in places.items():
        struct.pack_into("<BII", table, 9 * nid, 0, nid, where)
    image[(nat + 512) * BLOCK : (nat + 513) * BLOCK] = table

    def pack(begin, version, place):
        cp = bytearray(BLOCK)
        struct.pack_into("<Q", cp, 0, version)
        struct.pack_into("<III", cp, 132, 1, 8, 1)
        struct.pack_into("<III", cp, 156, 64, 64, 4092)
        cp[192 + 64] = 0x80  # the second copy of the first node table
        struct.pack_into("<I", cp, 4092, f2fs.checksum(bytes(cp[:4092])))
        for k in (0, 7):
            image[(begin + k) * BLOCK : (begin + k + 1) * BLOCK] = cp
        struct.pack_into("<HIBII", image, (begin + 1) * BLOCK + 3584, 1, 5, 0, 5, place)

    pack(checkpoint, 6, new_place)
    pack(checkpoint + 512, 5, old_place)
    return bytes(image), old_place, new_place


def test_f2fs():
    image, old_place, new_place = f2fs_image()
    fs = F2fs(lambda at, n: image[at : at + n], len(image))
    entries = {e["path"]: e for e in fs.walk()}
    assert set(entries) == {"inl", "dir", "dir/a name of more than eight", "link", "holes", "big", "dev"}
    read = lambda p: fs.data(*reversed(fs.find(p)))
    assert read("inl") == b"inline text" and read("holes") == NOISE[:4096] + bytes(4096) + NOISE[8192:9000] == read("dir/a name of more than eight")
    big = read("big")
    assert len(big) == 926 * BLOCK and big[925 * BLOCK :].rstrip(b"\0") == b"far" and not any(big[: 925 * BLOCK])
    assert entries["inl"]["xattrs"] == [("security.selinux", "u:r")] and entries["link"]["link"] == "target" and entries["dev"]["rdev"] == {"major": 259, "minor": 7}
    assert (entries["inl"]["mode"], entries["inl"]["uid"], entries["inl"]["gid"], entries["inl"]["mtime"]) == (0o644, 10, 20, 99)
    assert fs.journal == {5: new_place}
    # A newer checkpoint that was not written to its end doesn't count.
    torn = bytearray(image)
    torn[(512 + 7) * BLOCK + 100] ^= 1
    assert F2fs(lambda at, n: bytes(torn[at : at + n]), len(torn)).journal == {5: old_place}
    torn[(1024 + 7) * BLOCK + 100] ^= 1
    torn[1024 + 50] ^= 1
    with pytest.raises(Refused):
        F2fs(lambda at, n: bytes(torn[at : at + n]), len(torn))


def test_images_by_their_superblock(spark, tmp_path):
    (tmp_path / "e.img").write_bytes(erofs_image()[0])
    (tmp_path / "f.img").write_bytes(f2fs_image()[0])
    images = spark.createDataFrame([("e", str(tmp_path / "e.img")), ("f", f"file://{tmp_path}/f.img"), ("g", str(tmp_path / "g.img"))], "image string, location string")
    got = {(r["image"], r["path"]): r["error"] for r in ext.read_entries(images).collect()}
    assert ("e", "sub/deep") in got and ("f", "dir") in got and got["g", None]
    wanted = spark.createDataFrame([("e", "full"), ("f", "inl"), ("f", "gone")], "image string, path string")
    found = {(r["image"], r["path"]): r["content"] for r in ext.read_contents(images, wanted).collect()}
    assert bytes(found["e", "full"]) == b"ab" * 5000 + NOISE[:4000] and bytes(found["f", "inl"]) == b"inline text" and found["f", "gone"] is None
