"""A stream of lines that are appended to files it already knows.

Spark's file source reads each file once, whole. This source's offsets hold, for each file, its identity on disk, the byte behind its last
complete line and a hash of the bytes before that place. A batch reads, in splits, what lies between two offsets. A file keeps its identity
when it is renamed, so a rotated file is read to its end under its new name, if the pattern matches that too. If the
bytes before the old place have changed (the file was truncated, rewritten, or its identity given to another one), it is read from
its start. So every complete line arrives at least once, and a line that is still being written waits for its end.

    spark.dataSource.register(appended.AppendedLines)
    spark.readStream.format("appended_lines").option("path", "/spool/*.ndjson*").load()

Options: `path` (a glob pattern of files that every executor can open), `split_bytes`, `max_record_bytes`. A longer record comes with a
null value and its length, so it can be counted. The offsets name the files that exist, as Spark's own file source does on its driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, file string, at bigint, value string, n_bytes bigint"
GUARD_BYTES = 256
CHUNK_BYTES = 1 << 20
SPLIT_BYTES = 64 << 20


def split_lines(chunks: Iterable[bytes], at: int = 0, max_bytes: int | None = None) -> Iterator[tuple[int, bytes | None, int, bool]]:
    """(first byte, line without its end, bytes of the line, whether it has an end); a line over `max_bytes` has no content
    and is not held. The line's own bytes and one chunk are all that is held."""
    held: list[bytes] = []
    size = 0

    def line(last: bytes, ended: bool):
        whole = None if max_bytes is not None and size + len(last) > max_bytes else b"".join([*held, last])
        return at, whole[:-1] if whole is not None and ended and whole.endswith(b"\r") else whole, size + len(last), ended

    for chunk in chunks:
        *ends, rest = chunk.split(b"\n")
        for last in ends:
            found = line(last, True)
            yield found
            at += found[2] + 1
            held, size = [], 0
        size += len(rest)
        if rest and (max_bytes is None or size <= max_bytes):
            held.append(rest)
        elif rest:
            held = []
    if size:
        yield line(b"", False)


def _identity(file) -> str:
    import os

    facts = os.fstat(file.fileno())
    return f"{facts.st_dev}:{facts.st_ino}"


def _guard(file, end: int) -> str:
    """A hash of the bytes just before `end`."""
    import hashlib

    begin = max(0, end - GUARD_BYTES)
    file.seek(begin)
    return hashlib.sha256(file.read(end - begin)).hexdigest()[:16]


def _last_end(file, size: int) -> int:
    """The byte behind the last line end before `size`."""
    at = size
    while at:
        begin = max(0, at - CHUNK_BYTES)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


@dataclass
class Stretch(InputPartition):
    """Lines that begin in [begin, stop) of one file."""

    path: str
    file: str
    begin: int
    stop: int
    inside: bool  # `begin` may lie within a line, which then belongs to the stretch before

    def __post_init__(self) -> None:
        super().__init__(None)


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        limit = options.get("max_record_bytes")
        self.limit = None if limit is None else int(limit)
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        import glob
        import os

        files, known = {}, {}
        for path in sorted(glob.glob(self.pattern, include_hidden=True)):
            try:
                with open(path, "rb") as file:
                    facts = os.fstat(file.fileno())
                    if not os.path.isfile(path):
                        continue
                    own, mark = _identity(file), (path, facts.st_size, facts.st_mtime_ns)
                    before = self.known.get(own)
                    if before is None or before[0] != mark:
                        end = _last_end(file, facts.st_size)
                        before = mark, {"path": path, "end": end, "guard": _guard(file, end)}
                    known[own] = before
                    files[own] = before[1]
            except OSError:
                continue  # gone since it was listed; the next look decides
        self.known = known
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for own, now in end["files"].items():
            before, begin = start["files"].get(own), 0
            if before is not None and before["end"] <= now["end"]:
                if before["end"] == now["end"] and before["guard"] == now["guard"]:
                    continue
                try:
                    with open(now["path"], "rb") as file:
                        if _identity(file) != own or _guard(file, before["end"]) == before["guard"]:
                            begin = before["end"]
                except OSError:
                    begin = before["end"]
            for at in range(begin, now["end"], self.split):
                out.append(Stretch(now["path"], own, at, min(at + self.split, now["end"]), at > begin))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        with _opened(self.pattern, partition) as file:
            begin = partition.begin - 1 if partition.inside else partition.begin
            file.seek(begin)
            skip = partition.inside

            def chunks():
                while chunk := file.read(CHUNK_BYTES):
                    yield chunk

            for at, line, size, ended in split_lines(chunks(), begin, self.limit):
                if at >= partition.stop or not ended:
                    return
                if skip:
                    skip = False
                    continue
                yield partition.path, partition.file, at, None if line is None else line.decode("utf-8", "replace"), size


def _opened(pattern: str, partition: Stretch):
    """The file of a stretch, under its new name if it was renamed since the batch was planned."""
    import glob

    for path in (partition.path, *sorted(glob.glob(pattern, include_hidden=True))):
        try:
            file = open(path, "rb")
        except OSError:
            continue
        if _identity(file) == partition.file:
            return file
        file.close()
    raise FileNotFoundError(f"{partition.path} is gone before its lines were read")


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options)
