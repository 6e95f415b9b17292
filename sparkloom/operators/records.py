"""Transcript records to messages, and what is read around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.blocks import BLANK, standing, with_text
from ..functions.times import instant
from .ordering import numbered


def messages(records: DataFrame) -> DataFrame:
    """(rec_id, session, source_file, line_num, role, content, sent_at, has_tool_use): one row for each message.

    A message is a standing record of type user or assistant, without tool result, whose text is not blank. role is the
    record's type; sent_at is null where the time is unreadable.
    """
    speaks = records.where(F.col("type").isin("user", "assistant") & F.col("tool_use_result").isNull() & F.col("message.content").isNotNull())
    rows = with_text(speaks.join(standing(records), "rec_id", "left_semi")).where(~F.col("record_text").rlike(BLANK))
    return rows.select(
        "rec_id",
        "session",
        "source_file",
        "line_num",
        F.col("type").alias("role"),
        F.col("record_text").alias("content"),
        F.timestamp_micros(instant(F.col("timestamp"))).alias("sent_at"),
        ((F.col("type") == "assistant") & F.col("has_tool_use")).alias("has_tool_use"),
    )


def indexable(found: DataFrame) -> DataFrame:
    """The messages worth keeping."""
    return found.where(tx.is_indexable(F.col("content"), F.col("has_tool_use")))


def filter_counts(rows: DataFrame, content: str = "content", has_tool_use: Column | None = None) -> DataFrame:
    """(reason, n): how many rows each rule drops; reason is 'kept' for the others."""
    reason = F.coalesce(tx.filter_reason(F.col(content), has_tool_use), F.lit("kept"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def session_of(path: Column) -> Column:
    """Session name from a transcript's path: its project folder without the home prefix, else the file's stem."""
    folder = F.regexp_extract(path, r"/projects/([^/]+)/", 1)
    home = F.regexp_extract(folder, r"^-(?:Users|home)-[^-]+-(.+)$", 1)
    return F.when(folder == "", file_stem(path)).when(home != "", home).otherwise(F.regexp_replace(folder, "^-+", ""))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def folder_to_session(folder: Column, home: str = "") -> Column:
    """Session name of a working directory: the path below home, with dashes for slashes and dots; null if nothing is left."""
    below = F.when(folder.startswith(home), F.substring(folder, len(home) + 1, 1 << 30)).otherwise(folder)
    name = F.regexp_replace(F.regexp_replace(below, r"[/.]", "-"), "-+", "-")
    return F.nullif(F.regexp_replace(name, "^-|-$", ""), F.lit(""))


def match_session(sessions: DataFrame, name: str) -> DataFrame:
    """(session): the one known session that a name means: itself, itself in any case, as an ending, or by its last two parts."""
    low, known = F.lower(F.lit(name)), F.lower("session")
    tail = F.lit("-".join(name.lower().split("-")[-2:]))
    rank = F.when(F.col("session") == name, 1).when(known == low, 2).when(known.endswith(low) | low.endswith(known), 3).when(known.endswith(tail), 4)
    hits = sessions.select("session").where(F.col("session").isNotNull()).distinct().withColumn("rank", rank).where("rank IS NOT NULL")
    return hits.orderBy("rank", "session").limit(1).select("session")


def around(marks: DataFrame, rows: DataFrame, key: str, file: str, line: str, before: int = 5, after: int = 5, cut: int = 500) -> DataFrame:
    """(key, source_file, line_num, is_source, content): the rows up to so many lines around each mark, content cut short.

    marks has (key, file, line); rows has (source_file, line_num, content). An equi-join on file and line number: each mark
    names the lines it wants, so no file meets all its marks in one task.
    """
    wanted = marks.select(F.col(key).alias("key"), F.col(file).alias("source_file"), F.col(line).alias("mark"))
    wanted = wanted.withColumn("line_num", F.explode(F.sequence(F.col("mark") - before, F.col("mark") + after)))
    shown = rows.select("source_file", "line_num", F.substring("content", 1, cut).alias("content"))
    return wanted.join(shown, ["source_file", "line_num"]).select(F.col("key").alias(key), "source_file", "line_num", (F.col("line_num") == F.col("mark")).alias("is_source"), "content")


def neighbours_in_file(found: DataFrame, before: int = 2, after: int = 2, window: int = 10) -> DataFrame:
    """(rec_id, other_id, distance): the messages before and after each message in its file, by position, within window lines
    per message asked for."""
    rows = numbered(found.where(F.col("source_file").isNotNull()).select("source_file", "rec_id", "line_num"), ["source_file"], ["line_num", "rec_id"]).withColumn("place", F.col("place").cast("int"))
    wanted = rows.select("source_file", "rec_id", F.col("line_num").alias("mark"), F.col("place").alias("at"), F.explode(F.sequence(F.col("place") - before, F.col("place") + after)).alias("place"))
    other = rows.select("source_file", F.col("rec_id").alias("other_id"), "line_num", "place")
    near = F.col("line_num").between(F.col("mark") - before * window, F.col("mark") + after * window)
    return wanted.join(other, ["source_file", "place"]).where(near & (F.col("place") != F.col("at"))).select("rec_id", "other_id", (F.col("place") - F.col("at")).alias("distance"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both tables, one for each key: the new one where there is one, and of several the last by order.

    Rows with a null in the key are kept as they are. The result has old's columns.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(old.columns).withColumn("_new", F.lit(1)))
    nameless = F.when(~F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x), F.monotonically_increasing_id())
    rest = [c for c in old.columns if c not in keys and c not in order]
    last = F.max(F.struct("_new", *order, *rest)).alias("_last")
    merged = both.withColumn("_own", nameless).groupBy(*keys, "_own").agg(last)
    return merged.select([F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in old.columns])
