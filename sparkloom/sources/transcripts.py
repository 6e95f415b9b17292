"""Transcript files (JSON lines that grow at the end) as a batch and streaming source.

Spark's own file source takes files as unchanging. This one keeps a byte offset for each file and never reads past the last
complete line, so a half-written line comes with a later batch. Large ranges are read by several tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.records import session_of

SCHEMA = "source_file string, byte_start bigint, line string"
#: Bytes that one task reads.
SLICE = 64 << 20
SKIPPED = "subagents"


def list_files(root: str) -> list[str]:
    """Paths of all *.jsonl files below a folder, in order, without those in folders of helper transcripts."""
    found = []
    for folder, inner, names in os.walk(root):
        inner[:] = [d for d in inner if d != SKIPPED]
        found += [os.path.join(folder, n) for n in names if n.endswith(".jsonl")]
    return sorted(found)


def complete_bytes(path: str, start: int = 0, block: int = 1 << 16) -> int:
    """Where the last complete line of a file ends; start if there is none after it, and if the file got shorter."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        while end > start:
            at = max(start, end - block)
            f.seek(at)
            k = f.read(end - at).rfind(b"\n")
            if k >= 0:
                return at + k + 1
            end = at
    return start


class FileRange(InputPartition):
    """The lines of a file that begin in [start, stop); aligned: start is the beginning of a line."""

    def __init__(self, path: str, start: int, stop: int, end: int, aligned: bool):
        self.path, self.start, self.stop, self.end, self.aligned = path, start, stop, end, aligned


def ranges(path: str, start: int, end: int) -> list[FileRange]:
    cuts = [*range(start, end, SLICE), end]
    return [FileRange(path, a, b, end, a == start) for a, b in zip(cuts, cuts[1:], strict=False)]


def read_range(part: FileRange) -> Iterator[tuple]:
    with open(part.path, "rb") as f:
        at = part.start
        if not part.aligned:
            # A line belongs to the range in which it begins.
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < part.stop and at < part.end:
            line = f.readline()
            if not line:
                break
            text = line.decode("utf-8", "replace").strip()
            if text:
                yield (part.path, at, text)
            at += len(line)


class _Batch(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[FileRange]:
        return [r for p in list_files(self.root) for r in ranges(p, 0, complete_bytes(p))] or [FileRange("", 0, 0, 0, True)]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        return read_range(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root, self.seen = root, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = {p: complete_bytes(p, self.seen.get(p, 0)) for p in list_files(self.root)}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        return [r for p, stop in end.items() for r in ranges(p, start.get(p, 0), stop)] or [FileRange("", 0, 0, 0, True)]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        return read_range(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        """Offsets live in the query's checkpoint."""


class TranscriptSource(DataSource):
    """spark.read / readStream .format("transcripts").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TranscriptSource)
    return spark.read.format("transcripts").load(folder)


def stream_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TranscriptSource)
    return spark.readStream.format("transcripts").load(folder)


def records(lines: DataFrame) -> DataFrame:
    """Transcript records of raw lines: (source_file, byte_start, session, type, timestamp, message, tool_use_result).

    Lines that aren't JSON objects are left out. A list of blocks stays as JSON in message.content. byte_start orders the
    records of a file as line numbers do, without a count of the lines before.
    """
    field = lambda path: F.get_json_object("line", path)
    rows = lines.where(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull())
    return rows.select(
        "source_file",
        "byte_start",
        session_of(F.col("source_file")).alias("session"),
        field("$.type").alias("type"),
        field("$.timestamp").alias("timestamp"),
        F.struct(field("$.message.role").alias("role"), field("$.message.content").alias("content")).alias("message"),
        field("$.toolUseResult").alias("tool_use_result"),
    )
