"""A tail of growing files as a streaming table: whole lines only; part of a line waits until its end is written.

Files are found and read through a file system that the path names: a plain path or file:, and the schemes that pyarrow knows
(hdfs:, s3:, gs:, abfs:), or one that a user gives as the option `filesystem`, "module:function" of the path's scheme and
authority. The offset of a file is the place after its last whole line and a check sum of its first bytes, so a
file that was replaced begins anew, longer or shorter than the old one; a file that has shrunk begins anew as well.

Defined cases: an empty pattern match is no error, files may come later; blank lines go; bytes that are no UTF-8 are replaced; a file that goes
away is forgotten, and read again as a new one when it comes back.
"""

from __future__ import annotations

import fnmatch
import importlib
import re
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are looked at in one step for the last line's end, bytes of a file's beginning that tell it apart, bytes that a task reads.
STEP, HEAD, PART = 1 << 16, 1 << 10, 1 << 27


def file_system(path: str, factory: str | None = None):
    """The file system of a path (a pyarrow.fs.FileSystem), the path in it, and what stands before it in the names of files."""
    from pyarrow import fs

    scheme, slashes, rest = path.partition("://")
    if factory:
        module, _, function = factory.partition(":")
        authority, _, inner = rest.partition("/") if slashes else ("", "", path)
        return getattr(importlib.import_module(module), function)(scheme if slashes else "", authority), f"/{inner.lstrip('/')}", f"{scheme}://{authority}" if slashes else ""
    if slashes and scheme != "file":
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"
    local = rest if slashes else re.sub(r"^file:", "", path)
    return fs.LocalFileSystem(), local, ""


def matching(system, pattern: str) -> dict[str, int]:
    """Files and their sizes; wildcards are in the last part of the pattern only, or below a folder named without one."""
    from pyarrow import fs

    folder, _, name = pattern.rpartition("/")
    found = system.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True))
    return {f.path: f.size for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, name) and not f.base_name.startswith((".", "_"))}


def whole_until(system, path: str, size: int, start: int) -> int:
    """The place after the last line end of a file of `size` bytes, not before `start`."""
    at = size
    with system.open_input_file(path) as f:
        while at > start:
            low = max(start, at - STEP)
            found = f.read_at(at - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def head_of(system, path: str, n: int) -> int:
    """The check sum of the first `n` bytes."""
    with system.open_input_file(path) as f:
        return crc32(f.read_at(n, 0))


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    """Offsets are [place, bytes of the beginning, their check sum] by file, so a batch that runs again reads the same lines."""

    def __init__(self, pattern: str, factory: str | None = None):
        self.pattern, self.factory, self.seen = pattern, factory, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, inner, _ = file_system(self.pattern, self.factory)
        now = {}
        for path, size in sorted(matching(system, inner).items()):
            at, n, told = self.seen.get(path, (0, 0, 0))
            if size < at or n and head_of(system, path, n) != told:
                at, n, told = 0, 0, 0  # another file of this name
            end = whole_until(system, path, size, at)
            head = min(HEAD, end)
            now[path] = [end, head, head_of(system, path, head) if head > n else told]
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, _, _ = file_system(self.pattern, self.factory)
        spans = []
        for path, (to, n, told) in end.items():
            at, n_was, told_was = start.get(path, (0, 0, 0))
            same = to >= at and (n == n_was and told == told_was or n > n_was and head_of(system, path, n_was) == told_was)
            low = at if same else 0
            spans += [Span(path, low, to)] if to > low else []
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _, before = file_system(self.pattern, self.factory)
        with system.open_input_file(partition.path) as f:
            at, rest = partition.start, b""
            while at < partition.end:
                block = f.read_at(min(PART, partition.end - at), at)
                if not block:
                    raise OSError(f"{partition.path} is shorter than it was")
                at += len(block)
                lines = (rest + block).split(b"\n")
                place = at - len(rest) - len(block) if not rest else at - len(block) - len(rest)
                rest = lines.pop()
                for line in lines:
                    text = line.rstrip(b"\r").decode("utf-8", "replace")
                    if text:
                        yield before + partition.path, place, text
                    place += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """`spark.readStream.format("line_tail").option("path", "hdfs://logs/app/*.jsonl")`: rows (path, at, raw). All executors must reach the file system."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "path string, at long, raw string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(self.options["path"], self.options.get("filesystem"))
