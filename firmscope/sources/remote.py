"""Files that are read by ranges, so that readers take images larger than any buffer."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable

from pyarrow import fs


class Remote:
    """Bytes behind ``read_at(offset, size)``: slices are read when they are taken."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int, begin: int = 0):
        self._read_at, self._size, self._begin = read_at, size, begin

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, part: slice) -> bytes:
        at, to, step = part.indices(self._size)
        if step != 1:
            raise ValueError("bytes are read in order")
        return self._read_at(self._begin + at, to - at) if to > at else b""

    def window(self, at: int, size: int) -> Remote:
        """A range of the file as a file of its own."""
        if at < 0 or size < 0 or at + size > self._size:
            raise ValueError(f"{size} bytes at {at} are outside of {self._size}")
        return Remote(self._read_at, size, self._begin + at)


def refuse_blocking(path: str) -> str:
    """The path, unless opening it could wait forever: FIFOs and sockets are refused."""
    mode = os.stat(path).st_mode
    if stat.S_ISFIFO(mode) or stat.S_ISSOCK(mode):
        raise OSError(f"{path} is a FIFO or socket")
    return path


def open_remote(location: str) -> Remote:
    """A file of any file system that Arrow knows, or a local path."""
    where, inner = fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location)
    if isinstance(where, fs.LocalFileSystem):
        refuse_blocking(inner)
    f = where.open_input_file(inner)
    return Remote(lambda at, n: f.read_at(n, at), f.size())
