"""Files one after the other as one."""

from __future__ import annotations

import io
from bisect import bisect_right
from collections.abc import Sequence

from gridloom.sources.interim import file_system


class JoinedFile(io.RawIOBase):
    """Files one after the other as one seekable file; only what is read is fetched."""

    def __init__(self, paths: Sequence[str]):
        self.parts, self.starts, self.at, size = [], [], 0, 0
        for path in paths:
            files, place = file_system(path)
            part = files.open_input_file(place)
            self.parts.append(part)
            self.starts.append(size)
            size += part.size()
        self.size = size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        if self.at >= self.size or not len(buffer):
            return 0
        i = bisect_right(self.starts, self.at) - 1
        found = self.parts[i].read_at(min(len(buffer), self.parts[i].size() - (self.at - self.starts[i])), self.at - self.starts[i])
        buffer[: len(found)] = found
        self.at += len(found)
        return len(found)
