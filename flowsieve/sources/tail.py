"""A streaming source that follows growing text files, line by line.

The offset of the stream is a map from file to the bytes read, so an appended line of a file already seen is read once, and a new
file from its start. Only whole lines count: an offset ends behind a line end. A file that became shorter, or whose first bytes have
changed, was truncated or replaced and is read again from its start. A truncated file that has grown past its old offset with the same
first HEAD bytes can't be told from an appended one.

Byte ranges are cut into pieces of `bytesPerPartition`, which tasks read on their own: a piece has the lines that start in it. A batch of
more than PIECES such pieces is cut into longer ones, so that its tasks don't grow in number with the logs.

    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").load("/shared/logs")        # or a URI; option glob: "*.jsonl"

Files are read through Arrow's file systems, so a URI of any of these works on every executor.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position bigint, value string"
HEAD = 1024
BLOCK = 1 << 16
BYTES_PER_PARTITION = 1 << 25
PIECES = 512


class Piece(InputPartition):
    """Bytes of a file: lines that start from `start` on and before `stop`, none behind `end`."""

    def __init__(self, path: str, begin: int, start: int, stop: int, end: int):
        self.path, self.begin, self.start, self.stop, self.end = path, begin, start, stop, end


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> "TailReader":
        return TailReader(self.options["path"], self.options.get("glob", "*"),
                          int(self.options.get("bytesPerPartition", BYTES_PER_PARTITION)))


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str = "*", bytes_per_partition: int = BYTES_PER_PARTITION):
        self.folder, self.glob, self.bytes_per_partition = folder, glob, bytes_per_partition

    def _files(self):
        from pyarrow import fs
        if "://" in self.folder or self.folder.startswith("file:"):
            return fs.FileSystem.from_uri(self.folder)
        return fs.LocalFileSystem(), self.folder

    @staticmethod
    def _bytes(files, path: str, start: int, size: int) -> bytes:
        with files.open_input_file(path) as handle:
            handle.seek(start)
            return handle.read(size)

    def _whole(self, files, path: str, size: int) -> int:
        """Where the last whole line ends."""
        at = size
        while at > 0:
            start = max(0, at - BLOCK)
            found = self._bytes(files, path, start, at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
        return 0

    def _state(self, files, path: str, size: int) -> list[int]:
        """[bytes of whole lines, bytes of the head, the head's checksum]."""
        end = self._whole(files, path, size)
        head = self._bytes(files, path, 0, min(end, HEAD))
        return [end, len(head), zlib.crc32(head)]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs
        files, folder = self._files()
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.path: self._state(files, f.path, f.size) for f in sorted(found, key=lambda f: f.path)
                if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)}

    def _resumed(self, files, path: str, old: list[int] | None, new: list[int]) -> int:
        """Where reading goes on: behind the old offset, or at the start of a new, truncated or replaced file."""
        if old is None or new[0] < old[0]:
            return 0
        same = new[2] == old[2] if new[1] == old[1] else zlib.crc32(self._bytes(files, path, 0, old[1])) == old[2]
        return old[0] if same else 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        files, _ = self._files()
        begins = {path: self._resumed(files, path, start.get(path), new) for path, new in end.items()}
        size = max(self.bytes_per_partition, -(-sum(end[path][0] - begin for path, begin in begins.items()) // PIECES))
        pieces = []
        for path, begin in begins.items():
            stop = end[path][0]
            pieces += [Piece(path, begin, at, min(at + size, stop), stop) for at in range(begin, stop, size)]
        return pieces

    def read(self, partition: Piece) -> Iterator:
        import pyarrow as pa
        files, _ = self._files()
        with files.open_input_file(partition.path) as handle:
            at = partition.start
            if at > partition.begin:       # a line belongs to the piece it starts in
                handle.seek(at - 1)
                at += len(self._line(handle, partition.end - at + 1)) - 1
            handle.seek(at)
            rest = b""
            while at < partition.stop:
                block = handle.read(min(BLOCK, partition.end - at - len(rest)))
                rest += block
                cut = rest.rfind(b"\n") + 1
                if not block and not cut:
                    break
                lines, begins = [], []
                for line in rest[:cut].split(b"\n")[:-1]:
                    if at < partition.stop:
                        begins.append(at)
                        lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                rest = rest[cut:]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines)), pa.array(begins, pa.int64()), pa.array(lines)],
                                                     ["file", "position", "value"])

    @staticmethod
    def _line(handle, limit: int) -> bytes:
        """The bytes up to and with the next line end."""
        out = b""
        while len(out) < limit:
            block = handle.read(min(BLOCK, limit - len(out)))
            if not block:
                break
            found = block.find(b"\n")
            if found >= 0:
                return out + block[:found + 1]
            out += block
        return out
