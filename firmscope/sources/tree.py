"""What file systems have in common: the walk, the look-up by path, bounds."""

from __future__ import annotations

from collections.abc import Iterator

from firmscope.sources.images import Refused

MAX_ENTRIES = 1_000_000
MAX_DEPTH = 128
MAX_FILE = 1 << 31

# fixed values: kinds by mode bits, name spaces of extended attributes
KINDS = {0x1: "fifo", 0x2: "char", 0x4: "dir", 0x6: "block", 0x8: "file", 0xA: "symlink", 0xC: "socket"}
XATTR_PREFIX = {1: "user.", 2: "system.posix_acl_access", 3: "system.posix_acl_default", 4: "trusted.", 6: "security.", 7: "system.", 8: "system.richacl"}


def device(old: int, new: int) -> dict:
    """Major and minor number from the short or the long form."""
    return {"major": old >> 8 & 0xFF, "minor": old & 0xFF} if old else {"major": new >> 8 & 0xFFF, "minor": new & 0xFF | new >> 12 & 0xFFF00}


class Tree:
    """A file system with ``inode(number)``, ``children(inode, number)``, ``entry(path,
    number, inode)`` and ``data(inode, number)``."""

    root: int

    def walk(self) -> Iterator[dict]:
        """All entries below the root, sorted by path; loops and runaways are refused."""
        found: list[dict] = []

        def visit(path: str, ino: int, above: frozenset[int]) -> None:
            if ino in above or len(above) > MAX_DEPTH:
                raise Refused(f"{path or '/'} loops")
            for name, child in sorted(self.children(self.inode(ino), ino).items()):
                inner = f"{path}/{name}" if path else name
                e = self.entry(inner, child, self.inode(child))
                found.append(e)
                if len(found) > MAX_ENTRIES:
                    raise Refused("too many entries")
                if e["kind"] == "dir":
                    visit(inner, child, above | {ino})

        visit("", self.root, frozenset())
        yield from sorted(found, key=lambda e: e["path"].encode())

    def find(self, path: str) -> tuple[int, bytes]:
        ino = self.root
        for name in path.split("/"):
            ino = self.children(self.inode(ino), ino).get(name)
            if ino is None:
                raise Refused(f"no such path: {path}")
        return ino, self.inode(ino)
