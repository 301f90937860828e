"""Vendors' firmware containers: where the images lie in them, by checked tables."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from firmscope.sources.images import READERS, Refused, _inside, _take, _unpack

MAX_ITEMS = 4096
MAX_IMAGE = 64 << 30


def clean_name(raw: bytes) -> str:
    """A partition name from a padded field: letters, digits and ``._-`` only."""
    text = raw.split(b"\0")[0].decode("latin-1")
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}", text):
        raise Refused(f"unsafe partition name {text[:32]!r}")
    return text.lower()


def _images(rows: Iterator[dict], data) -> Iterator[dict]:
    """Checked rows: unique names, ranges inside, sizes bounded; sparse images count as unpacked."""
    seen: set[str] = set()
    for r in rows:
        if r["name"] in seen:
            raise Refused(f"two images are called {r['name']}")
        seen.add(r["name"])
        if len(seen) > MAX_ITEMS:
            raise Refused("too many images")
        for x in r["ranges"]:
            _inside(data, x["offset"], x["size"])
        if not r["packed"]:
            head = bytes(data[r["ranges"][0]["offset"] : r["ranges"][0]["offset"] + 20])
            if head[:4] == b"\x3a\xff\x26\xed" and len(head) == 20 and r["size"] >= 20:
                block, blocks = struct.unpack_from("<II", head, 12)
                r |= {"sparse": True, "size": block * blocks}
        if r["size"] > MAX_IMAGE:
            raise Refused(f"{r['name']} is too large")
        yield r


def _plain(name: str, offset: int, size: int) -> dict:
    return {"name": name, "size": size, "packed": False, "sparse": False, "ranges": [{"offset": offset, "size": size, "begin": 0, "unpacked": size}]}


def huawei_app(data) -> Iterator[dict]:
    """Records, one behind the other at multiples of four: a head, then an image."""

    def rows():
        at, n = 0, 0
        while at + 82 <= len(data):
            head = _take(data, at, 82)
            if head[:4] != b"\x55\xaa\x5a\xa5":
                if n and not any(head):
                    break
                raise Refused(f"no record at {at}")
            length, size = struct.unpack_from("<I", head, 4)[0], struct.unpack_from("<I", head, 24)[0]
            if length < 82:
                raise Refused("the record's head is too short")
            yield _plain(clean_name(head[60:76]) + ".img", at + length, size)
            at, n = (at + length + size + 3) // 4 * 4, n + 1
        if not n:
            raise Refused("no records")

    return _images(rows(), data)


def lg_dz(data, base: int = 0, size: int | None = None) -> Iterator[dict]:
    """Partitions from zlib chunks, each with its place in the image in sectors."""
    end = base + (len(data) if size is None else size)
    head = _take(data, base, 512)
    count = struct.unpack_from("<I", head, 0xC0)[0]
    if head[:4] != b"\x32\x96\x18\x74" or not 0 < count <= MAX_ITEMS * 64:
        raise Refused("not a DZ file")
    parts: dict[str, list[dict]] = {}
    at = base + 512
    for _ in range(count):
        if at + 512 > end:
            raise Refused("the chunks end early")
        chunk = _take(data, at, 512)
        if chunk[:4] != b"\x30\x12\x95\x78":
            raise Refused(f"no chunk at {at}")
        unpacked, packed = struct.unpack_from("<II", chunk, 0x28)
        start, first = struct.unpack_from("<I", chunk, 0x40)[0], struct.unpack_from("<I", chunk, 0x48)[0]
        if start < first or at + 512 + packed > end:
            raise Refused("a chunk lies outside")
        parts.setdefault(clean_name(chunk[8:40]), []).append({"offset": at + 512, "size": packed, "begin": (start - first) * 512, "unpacked": unpacked})
        at += 512 + packed
    rows = ({"name": f"{n}.img", "size": max(c["begin"] + c["unpacked"] for c in chunks), "packed": True, "sparse": False, "ranges": chunks} for n, chunks in parts.items())
    return _images(rows, data)


def lg_kdz(data) -> Iterator[dict]:
    """The one DZ file that a KDZ file's table names."""
    magic = _take(data, 0, 8)
    if magic == b"\x28\x05\0\0\x34\x31\x25\x80":
        raise Refused("KDZ version 1 can't be read")
    if magic != b"\x24\x05\0\0\x38\x31\x25\x80":
        raise Refused("not a KDZ file")
    inner: list[tuple[int, int]] = []
    for k in range(64):
        record = _take(data, 8 + 272 * k, 272)
        name = record[:256].split(b"\0")[0].decode("utf-8", "replace").lower()
        if not name:
            break
        size, offset = struct.unpack_from("<QQ", record, 256)
        _inside(data, offset, size)
        if name.endswith(".dz"):
            inner.append((offset, size))
    if len(inner) != 1:
        raise Refused(f"{len(inner)} DZ files instead of one")
    return lg_dz(data, *inner[0])


def sony_sin(data, stem: str = "sin") -> Iterator[dict]:
    """The image behind a version 3 header; wrapped payloads are refused."""
    magic, length = _unpack(">4sI", data)
    if magic != b"\x03SIN" or not 8 <= length < len(data):
        raise Refused("not a version 3 SIN file")
    head = bytes(data[length : length + 6])
    # fixed values: magic numbers of compressions
    wraps = (b"\x1f\x8b\x08", b"\xfd7zXZ\0", b"BZh", b"\x04\x22\x4d\x18", b"\x02\x21\x4c\x18", b"\x28\xb5\x2f\xfd", b"PK\x03\x04", b"PK\x05\x06")
    if head.startswith(wraps):
        raise Refused("the payload is compressed")
    name = clean_name(re.sub(r"[^A-Za-z0-9._-]", "_", stem).encode()) + ".img"
    return _images(iter([_plain(name, length, len(data) - length)]), data)


def nokia_nb0(data) -> Iterator[dict]:
    """A counted table of images."""
    count = _unpack("<I", data)[0]
    if not 0 < count <= MAX_ITEMS:
        raise Refused("not an NB0 file")
    table = _take(data, 4, 48 * count)

    def rows():
        for k in range(count):
            offset, size = struct.unpack_from("<II", table, 48 * k)
            if offset < 4 + len(table):
                raise Refused("an image lies in the table")
            name = clean_name(table[48 * k + 16 : 48 * k + 48])
            yield _plain(name if name.endswith(".img") else name + ".img", offset, size)

    return _images(rows(), data)


def coolpad_cpb(data) -> Iterator[dict]:
    raise Refused("CPB files are named, but their layout is not public")


def pac_files(data) -> Iterator[dict]:
    """Files of a PAC container: records of fixed size, UTF-16 names, 0 for unused ones."""
    for at in range(60, 69721 - 2580 + 1, 2580):
        if at + 2580 > len(data):
            break
        record = _take(data, at, 2580)
        size, offset = struct.unpack_from("<I", record, 0x400)[0], struct.unpack_from("<I", record, 0x40C)[0]
        if not offset or offset + size > len(data):
            continue
        name = record[:64].decode("utf-16-le").split("\0")[0]
        if size > 1 << 30:
            raise Refused(f"{name} is too large")
        if not name or re.search(r"[/\\:\x00-\x1f\x7f-\x9f]|\.\.", name):
            raise Refused(f"unsafe name {name!r}")
        yield {"name": name, "offset": offset, "size": size}


def image_bytes(data, row: dict) -> bytes:
    """One image of a container: its range, or its chunks unpacked into place."""
    if not row["packed"]:
        x = row["ranges"][0]
        return bytes(_take(data, x["offset"], x["size"]))
    out = bytearray(row["size"])
    for x in row["ranges"]:
        z = zlib.decompressobj()
        piece = z.decompress(_take(data, x["offset"], x["size"]), x["unpacked"] + 1)
        if len(piece) != x["unpacked"]:
            raise Refused("a chunk has the wrong size")
        out[x["begin"] : x["begin"] + len(piece)] = piece
    return bytes(out)


def amlogic(data) -> dict:
    """Facts of an Amlogic container; its payload is never guessed at."""
    magic, version = _unpack("<4sI", data)
    size, align = _unpack("<II", data, 16)
    if magic != b"@AML" or align < 24 or align + size != len(data):
        raise Refused("not an Amlogic container")
    bits = entropy(_take(data, align, size))
    return {"version": version, "offset": align, "size": size, "entropy": bits, "encrypted": bits >= 7.9}


def entropy(data: bytes) -> float:
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(len(data), 1)
    return float(-(p * np.log2(p)).sum()) + 0.0


def _aes_boxes() -> tuple[np.ndarray, np.ndarray]:
    """The AES substitution and its inverse: inverses in GF(256), then an affine map."""
    power = np.zeros(256, np.int64)
    x = 1
    for k in range(255):
        power[k] = x
        x = x ^ (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    log = {int(v): k for k, v in enumerate(power[:255])}
    box = np.zeros(256, np.uint8)
    for v in range(256):
        inverse = int(power[(255 - log[v]) % 255]) if v else 0
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 0xFF
        box[v] = turned ^ 0x63
    return box, np.argsort(box).astype(np.uint8)


_BOX, _UNBOX = _aes_boxes()


def _times(v: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(v)
    while by:
        if by & 1:
            out = out ^ v
        v = (v << 1) ^ np.where(v & 0x80, 0x1B, 0).astype(np.uint8)
        by >>= 1
    return out


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """AES-128, each block for itself, all blocks at once."""
    words = [list(key[4 * k : 4 * k + 4]) for k in range(4)]
    constant = 1
    for k in range(4, 44):
        w = list(words[-1])
        if k % 4 == 0:
            w = [int(_BOX[x]) for x in w[1:] + w[:1]]
            w[0] ^= constant
            constant = (constant << 1) ^ (0x11B if constant & 0x80 else 0)
        words.append([a ^ b for a, b in zip(words[k - 4], w, strict=True)])
    rounds = np.array(words, np.uint8).reshape(11, 16)
    state = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ rounds[10]
    # Row r of the state (bytes r, r + 4, ...) turns right by r.
    turn = np.array([(4 * (c - r) + r) % 16 for c in range(4) for r in range(4)])
    for k in range(9, -1, -1):
        state = _UNBOX[state[:, turn]] ^ rounds[k]
        if k:
            columns = state.reshape(-1, 4, 4)
            mixed = np.zeros_like(columns)
            for r in range(4):
                for j, by in enumerate((14, 11, 13, 9)):
                    mixed[:, :, r] ^= _times(columns[:, :, (r + j) % 4], by)
            state = mixed.reshape(-1, 16)
    return state.tobytes()


# fixed values: published keys of encrypted zips, by device
OZIP_KEYS = {
    "mnkey": "D6EECF0AE5ACD4E0E9FE522DE7CE381E",
    "mkey": "D6ECCF0AE5ACD4E0E92E522DE7C1381E",
    "R9s CPH1607 / RMX1921 / RMX1851EX": "D6DCCF0AD5ACD4E0292E522DB7C1381E",
    "testkey": "D7DCCE1AD4AFDCE2393E5161CBDC4321",
    "utilkey": "D7DBCE2AD4ADDCE1393E5521CBDC4321",
    "R11s CPH1719 / Plus": "D7DBCE1AD4AFDCE1393E5121CBDC4321",
    "FindX CPH1871": "D4D2CD61D4AFDCE13B5E01221BD14D20",
    "FindX": "261CC7131D7C1481294E532DB752381E",
    "Realme 2 pro": "1CA21E12271335AE33AB81B2A7B14622",
    "K1 SDM660/MSM8976": "D4D2CE11D4AFDCE13B3E0121CBD14D20",
    "Realme 3 Pro / X / 5 Pro / Q": "1C4C1EA3A12531AE491B21BB31613C11",
    "Reno 10x zoom / CPH1921EX": "1C4C1EA3A12531AE4A1B21BB31C13C21",
    "Reno 2 PCKM00": "1C4A11A3A12513AE441B23BB31513121",
    "Realme X2": "1C4A11A3A12589AE441A23BB31517733",
    "Realme 5 SDM665": "1C4A11A3A22513AE541B53BB31513121",
    "R17 Pro SDM710": "2442CE821A4F352E33AE81B22BC1462E",
    "CPH1803 OppoA3s": "14C2CD6214CFDC2733AE81B22BC1462C",
    "A77 CPH1715": "2D23CCBBA1563519CE23C1C4AA1E3412",
    "Realme 1 MTK P60": "172B3E14E46F3CE13E2B5121CBDC4321",
    "Realme U1 RMX1831": "ACAA1E12A71431CE4A1B21BBA1C1C6A2",
    "Realme 3 RMX1825EX": "ACAC1E13A72531AE4A1B22BB31C1CC22",
    "A1k CPH1923": "1C4411A3A12533AE441B21BB31613C11",
    "Reno 3 PCRM00 / CPH2059 / CPH2067": "1C4416A8A42717AE441523B336513121",
    "RenoAce SDM855Plus": "55EEAA33112133AE441B23BB31513121",
    "Reno / K3": "ACAC1E13A12531AE4A1B22BB31C13C21",
    "A9": "ACAC1E13A72431AE4A1B22BBA1C1C6A2",
    "A1 / A83t": "12CAC11211AAC3AEA2658690122C1E81",
    "CPH1909 OppoA5s": "1CA21E12271435AE331B81BBA7C14612",
    "Realme 1 (reserved)": "D1DACF24351CE428A9CE32ED87323216",
}
_OZIP_PIECE = 1 << 20


def ozip_facts(data) -> dict:
    """Size of the plain file and the device whose key opens it, by the probe block."""
    head = _take(data, 0, 0x1050)
    if head[:12] != b"OPPOENCRYPT!":
        raise Refused("not an ozip file")
    text = head[16:32].replace(b"\0", b"").decode("ascii").strip()
    if not text.isdigit():
        raise Refused("the size is no number")
    for device, key in OZIP_KEYS.items():
        if aes_decrypt(bytes.fromhex(key), head[0x50:0x60])[:4] in (b"PK\x03\x04", b"AVB0", b"ANDR"):
            return {"device": device, "size": int(text)}
    raise Refused("no known key opens this file")


def ozip_pieces(data) -> Iterator[bytes]:
    """The plain file, piece by piece."""
    facts = ozip_facts(data)
    key, left = bytes.fromhex(OZIP_KEYS[facts["device"]]), facts["size"]
    if len(data) - 0x1050 < -(-left // 16) * 16:
        raise Refused("the payload ends early")
    at = 0x1050
    while left:
        n = min(_OZIP_PIECE, -(-left // 16) * 16)
        plain = aes_decrypt(key, _take(data, at, n))[:left]
        yield plain
        at, left = at + n, left - len(plain)


READERS |= {"huawei-update-app": huawei_app, "lg-kdz": lg_kdz, "lg-dz": lg_dz, "sony-sin": sony_sin, "nokia-nb0": nokia_nb0, "coolpad-cpb": coolpad_cpb, "pac": pac_files, "aml-container": lambda data: iter([amlogic(data)]), "ozip": lambda data: iter([ozip_facts(data)])}
