"""The memory's own tables: which rows count, how ideas, spans, topics and projects belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTECTED = ("decision", "conclusion")
#: Importance of an idea by its intent.
IMPORTANCE = {"decision": 1.0, "conclusion": 1.0, "solution": 0.8, "problem": 0.6, "question": 0.5, "todo": 0.7, "context": 0.3}
SPAN_ORDER = ("end_time", "end_line", "depth", "topic_id", "start_time", "created_at", "start_line", "name", "summary", "session", "parent_id")


def spans(rows: DataFrame) -> DataFrame:
    """One row for each span id: the greatest by (end_time, end_line, depth, ...), nulls least, so the latest state."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct(*SPAN_ORDER)).alias("s")).select("id", *[F.col("s")[c].alias(c) for c in SPAN_ORDER])


def when_said() -> Column:
    """When an idea was said: the time of its message, else its own."""
    return F.coalesce("message_time", "created_at").cast("timestamp")


def visible(ideas: DataFrame) -> DataFrame:
    return ideas.where(~F.coalesce(F.col("forgotten"), F.lit(False)))


def with_topic(ideas: DataFrame, span_rows: DataFrame) -> DataFrame:
    """Ideas with their span's topic_id, null where they have none."""
    return ideas.join(spans(span_rows).select(F.col("id").alias("span_id"), "topic_id"), "span_id", "left")


def importance(intent: Column) -> Column:
    out = None
    for name, value in IMPORTANCE.items():
        out = F.when(intent == name, value) if out is None else out.when(intent == name, value)
    return out.otherwise(0.3)


def should_preserve(intent: Column, confidence: Column) -> Column:
    return F.coalesce(intent.isin(*PROTECTED), F.lit(False)) | F.coalesce(confidence >= 0.9, F.lit(False))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed intervals that meet; false where an end is null."""
    return F.coalesce((start_a <= end_b) & (start_b <= end_a), F.lit(False))
