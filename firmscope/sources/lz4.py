"""LZ4 data: frames and the legacy form that kernels use, decoded within a bound."""

from __future__ import annotations

import struct

from firmscope.sources.images import Refused, _take

# fixed values: magic numbers and the legacy form's block size
FRAME, LEGACY, SKIPPABLE = 0x184D2204, 0x184C2102, 0x184D2A5
LEGACY_BLOCK = 8 << 20


def block(data: bytes, most: int, before: bytearray | None = None, stop: bool = False) -> bytearray:
    """One block: literals, then copies from what is out already, over and over. It may
    not be longer than ``most``; with ``stop`` it is cut there, and what follows in
    the data is padding."""
    out = bytearray() if before is None else before
    start, at, end = len(out), 0, len(data)

    def length(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                more = _take(data, at, 1)[0]
                at += 1
                n += more
                if more < 255:
                    break
        return n

    while at < end:
        token = data[at]
        at += 1
        n = length(token >> 4)
        if stop:
            n = min(n, most - (len(out) - start))
        out += _take(data, at, n)
        at += n
        if at == end or (stop and len(out) - start == most):
            break
        back = struct.unpack("<H", _take(data, at, 2))[0]
        at += 2
        n = length(token & 15) + 4
        if not 0 < back <= len(out):
            raise Refused("a copy begins before the data")
        if stop:
            n = min(n, most - (len(out) - start))
        if len(out) - start + n > most:
            raise Refused("the data is longer than its bound")
        piece = bytes(out[-back:])
        out += (piece * (n // back + 1))[:n]
    if len(out) - start > most:
        raise Refused("the data is longer than its bound")
    return out


def decompress(data: bytes, most: int = 2 << 30) -> bytes:
    """Frames or legacy data, until the bytes end."""
    magic = struct.unpack("<I", _take(data, 0, 4))[0]
    if magic == LEGACY:
        return _legacy(data, most)
    out, at = bytearray(), 0
    while at < len(data):
        magic = struct.unpack("<I", _take(data, at, 4))[0]
        if magic >> 4 == SKIPPABLE:
            at += 8 + struct.unpack("<I", _take(data, at + 4, 4))[0]
            continue
        if magic != FRAME:
            raise Refused("not an lz4 frame")
        flags, sizes = _take(data, at + 4, 2)
        if flags >> 6 != 1:
            raise Refused("unknown frame version")
        at += 7 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
        if flags & 1:
            raise Refused("frames with dictionaries can't be read")
        largest, linked = 1 << (8 + 2 * (sizes >> 4 & 7)), not flags & 0x20
        while True:
            size = struct.unpack("<I", _take(data, at, 4))[0]
            at += 4
            if not size:
                break
            body = _take(data, at, size & 0x7FFFFFFF)
            at += len(body) + (4 if flags & 0x10 else 0)
            room = min(largest, most - len(out))
            if size >> 31:
                if len(body) > room:
                    raise Refused("the data is longer than its bound")
                out += body
            elif linked:
                block(body, room, out)
            else:
                out += block(body, room)
        at += 4 if flags & 4 else 0
    return bytes(out)


def _legacy(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 4
    while at + 4 <= len(data):
        size = struct.unpack("<I", _take(data, at, 4))[0]
        at += 4
        if size == LEGACY:  # archives may follow each other
            continue
        if size > len(data) - at:
            break  # what follows is not lz4 data (kernels append their size)
        out += block(_take(data, at, size), min(LEGACY_BLOCK, most - len(out)))
        at += size
    return bytes(out)
