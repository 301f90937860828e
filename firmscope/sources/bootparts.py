"""Vendor boot images and device tree overlays: sections by checked tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from firmscope.sources.images import READERS, Refused, _inside, _take, _unpack, fdt_nodes

MAX_ENTRIES = 4096


def vendor_boot_sections(data) -> Iterator[dict]:
    """Sections of vendor boot images, versions 3 and 4, each in whole pages."""
    head = _take(data, 0, 2112)
    version, page = struct.unpack_from("<II", head, 8)
    if head[:8] != b"VNDRBOOT" or version not in (3, 4):
        raise Refused("not a vendor boot image")
    if not 512 <= page <= 1 << 20 or page & (page - 1):
        raise Refused("bad page size")
    ramdisk, header, dtb = struct.unpack_from("<I", head, 24)[0], *struct.unpack_from("<II", head, 2096)
    pages = lambda n: -(-n // page)
    base = pages(header) * page
    dtb_at = base + pages(ramdisk) * page
    found: list[tuple[str, int, int, str]] = []
    if version == 3:
        found.append(("vendor_ramdisk", base, ramdisk, ""))
    else:
        table, count, width, config = _unpack("<4I", data, 2112)
        if count > MAX_ENTRIES or (count and width < 108):
            raise Refused("bad ramdisk table")
        table_at = dtb_at + pages(dtb) * page
        for k in range(count):
            entry = _take(data, table_at + k * width, 108)
            size, offset = struct.unpack_from("<II", entry)
            found.append((f"vendor_ramdisk{k:02}", base + offset, size, entry[12:44].split(b"\0")[0].decode("utf-8", "replace")))
        found.append(("bootconfig", table_at + pages(table) * page, config, ""))
    found.append(("dtb", dtb_at, dtb, ""))
    for name, at, size, label in found:
        if size:
            _inside(data, at, size)
            yield {"name": name, "offset": at, "size": size, "version": version, "label": label}


def dtbo_entries(data) -> Iterator[dict]:
    """Entries of an overlay table; ``nodes`` counts the tree's properties, null where an
    entry holds no device tree that can be read."""
    magic, _, header, width, count, at, page = _unpack(">7I", data)
    if magic != 0xD7B7AB1E or not 32 <= header <= len(data) or width < 12 or count > MAX_ENTRIES:
        raise Refused("not an overlay table")
    _inside(data, at, width * count)
    for k in range(count):
        size, offset, ident, revision = _unpack(">4I", data, at + k * width) if width >= 16 else (*_unpack(">3I", data, at + k * width), 0)
        nodes = None
        if offset + size <= len(data):
            try:
                nodes = sum(1 for _ in fdt_nodes(bytes(data[offset : offset + size])))
            except (Refused, ValueError, struct.error):
                nodes = None
        yield {"n": k, "offset": offset, "size": size, "id": ident, "revision": revision, "page_size": page, "nodes": nodes}


READERS |= {"vendor-boot": vendor_boot_sections, "dtbo": dtbo_entries}
