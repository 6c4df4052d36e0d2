"""A streaming source of text files that grow (Spark's own file source reads a file once and never again).

The offset is the place up to which each file has been read, always behind a line end.  A trigger reads what
came since, by byte blocks, so a large file or backlog is many tasks.  ``finished=true`` also takes a last line
without an end (for files that no longer grow).  Files only grow: one that got shorter is an error.
``pyarrow.fs`` opens the files, from the executors: local and shared mounts, ``hdfs://``, ``s3://``, ``gs://``.

The offset names every file under ``path``, so it suits some hundred thousand of them.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string"
_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string())])
#: bytes read at once when looking for a line end
STEP = 1 << 16


def _open(path: str):
    """(filesystem, path there, what stands before it in names)."""
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def line_end(f, start: int, end: int) -> int:
    """The place behind the last line end in [start, end), or ``start``."""
    while end > start:
        a = max(start, end - STEP)
        f.seek(a)
        at = f.read(end - a).rfind(b"\n")
        if at >= 0:
            return a + at + 1
        end = a
    return start


@dataclass
class Block(InputPartition):
    """Lines of ``file`` that start in [start, end); ``limit`` is where the trigger's range ends."""
    file: str
    start: int
    end: int
    limit: int
    fresh: bool   # the range starts here, so a line does


def block_lines(f, block: Block) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start in a block."""
    at = block.start
    if not block.fresh:
        # a line starts here only if the byte before ends one
        at -= 1
    f.seek(at)
    rest, first = b"", not block.fresh
    while True:
        got = f.read(min(STEP * 16, block.limit - at - len(rest)))
        rest += got
        lines = rest.split(b"\n")
        rest = lines.pop()
        for line in lines:
            if first:
                first = False
            elif at < block.end:
                yield at, line
            else:
                return
            at += len(line) + 1
        if not got:
            if rest and not first and at < block.end:
                yield at, rest
            return
        if at >= block.end:
            return


class GrowingTextReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.block = int(options.get("block_bytes", 64 << 20))
        self.finished = options.get("finished", "false") == "true"
        self.read_so_far: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs
        system, inner, before = _open(self.path)
        out = dict(self.read_so_far)
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")) or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            name, size = before + info.path, info.size
            seen = out.get(name, 0)
            if size > seen and not self.finished:
                with system.open_input_file(info.path) as f:
                    size = line_end(f, seen, size)
            if size > seen:
                out[name] = size
        self.read_so_far = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Block]:
        out = []
        for name, limit in end.items():
            a = start.get(name, 0)
            if limit < a:
                raise ValueError(f"{name} has become shorter")
            out += [Block(name, s, min(s + self.block, limit), limit, s == a) for s in range(a, limit, self.block)]
        self.read_so_far = dict(end)
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        system, inner, _ = _open(partition.file)
        held: list[tuple[int, str]] = []
        with system.open_input_file(inner) as f:
            for at, line in block_lines(f, partition):
                held.append((at, line.decode("utf-8", "replace")))
                if len(held) == 10_000:
                    yield _batch(partition.file, held)
                    held = []
        if held:
            yield _batch(partition.file, held)

    def commit(self, end: dict) -> None:
        self.read_so_far = {**self.read_so_far, **end}


def _batch(file: str, rows: list) -> pa.RecordBatch:
    at, lines = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(at, pa.int64()), pa.array(lines)], schema=_ARROW)


class GrowingText(DataSource):
    """``spark.readStream.format("growing_text").option("path", folder)``: (file, at, line), ``at`` a line's place in bytes.

    Options: ``pattern`` of the file names, ``block_bytes``, ``finished``."""

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingTextReader:
        return GrowingTextReader(self.options)
