"""Incremental ingestion: batches by pauses, spans by topic turns, and a sink that may be repeated.

Each file (or session) keeps a few numbers as state. Spark hands a micro-batch's rows of a file over in chunks of any order, so
their places and times (some 20 bytes a row) are put in order first; how much a micro-batch holds is the source's to bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.batching import topic_turns

GAP_OUT = "source_file string, byte_start bigint, batch_start bigint"
SPAN_OUT = "source_file string, byte_start bigint, span bigint, parent bigint, depth int"


def in_order(rows: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[int, object]]:
    """(byte_start, column) of all chunks, by byte_start."""
    whole = pd.concat([pdf[["byte_start", column]] for pdf in rows], ignore_index=True).sort_values("byte_start", kind="stable")
    yield from zip(whole["byte_start"].tolist(), whole[column].tolist(), strict=True)


def frames(found: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size."""
    while part := list(islice(found, 10_000)):
        yield pd.DataFrame(part, columns=columns)


class GapBatches(StatefulProcessor):
    """The batch of each message: a new one after a pause, or after so many messages."""

    def __init__(self, seconds: float = 5.0, most: int = 100):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("batch", "start bigint, size bigint, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        start, size, at = self.state.get() if self.state.exists() else (None, 0, None)

        def placed() -> Iterator[tuple]:
            nonlocal start, size, at
            for byte, t in in_order(rows, "at"):
                if start is None or t - at > self.seconds * 1_000_000 or size >= self.most:
                    start, size = int(byte), 0
                size, at = size + 1, int(t)
                yield key[0], int(byte), start

        yield from frames(placed(), ["source_file", "byte_start", "batch_start"])
        if start is not None:
            self.state.update((start, size, at))

    def close(self) -> None:
        pass


class SpanStack(StatefulProcessor):
    """The span of each message: back leaves the innermost span, deeper opens one in it, shift opens one beside all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stack", "spans array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        stack = list(self.state.get()[0]) if self.state.exists() else []

        def placed() -> Iterator[tuple]:
            nonlocal stack
            for byte, turn in in_order(rows, "turn"):
                if turn == "back" and len(stack) > 1:
                    stack.pop()
                elif turn == "deeper" and stack:
                    stack.append(int(byte))
                elif turn == "shift" or not stack:
                    stack = [int(byte)]
                yield key[0], int(byte), stack[-1], stack[-2] if len(stack) > 1 else None, len(stack) - 1

        for frame in frames(placed(), ["source_file", "byte_start", "span", "parent", "depth"]):
            yield frame.astype({"parent": "Int64"})
        self.state.update((stack,))

    def close(self) -> None:
        pass


def stream_gap_batches(messages: DataFrame, seconds: float = 5.0, most: int = 100) -> DataFrame:
    """(source_file, byte_start, batch_start) of a stream of messages (source_file, byte_start, at in microseconds)."""
    rows = messages.select("source_file", "byte_start", "at").groupBy("source_file")
    return rows.transformWithStateInPandas(GapBatches(seconds, most), GAP_OUT, "append", "none")


def stream_spans(messages: DataFrame) -> DataFrame:
    """(source_file, byte_start, span, parent, depth) of a stream of messages (source_file, byte_start, content); a span is
    named by the place of its first message."""
    turned = topic_turns(messages.withColumnRenamed("byte_start", "rec_id").select("source_file", "rec_id", "content"), keep=["source_file"])
    return turned.withColumnRenamed("rec_id", "byte_start").groupBy("source_file").transformWithStateInPandas(SpanStack(), SPAN_OUT, "append", "none")


def windowed_activity(messages: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(session, start, stop, n): messages by event-time session windows, late ones accepted for a while."""
    rows = messages.withWatermark("sent_at", late).groupBy("session", F.session_window("sent_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def write_epochs(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts a query that writes each micro-batch to its own folder, so that a repeated batch replaces itself."""

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
