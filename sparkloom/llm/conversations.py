"""Message rows to whole conversations.

Rows are an event log. fold_log() folds creates, edits, deletes and retries of a record, by version, into its final state;
conversations() orders the turns that stand and keeps the sessions that are whole. A session may hold any share of all
rows: turns are laid out by range over (session, instant, file, line), so a long session spreads over many partitions, and
only a few numbers of each stretch of a session in a partition are carried over to the next stretch.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import BLANK, with_text
from ..functions.times import instant
from ..session import materialize, shared_dir

SPEAKERS = ("user", "assistant")
ORDER = ("at", "source_file", "line_num", "rec_id")


def fold_log(log: DataFrame, key: list[str], version: str, op: str | None = None) -> DataFrame:
    """One row for each key: its final state, without the column op.

    Without op every row delivers the same record: the first version stands and later ones are retries. With op (create,
    edit, retry, delete, in any case): the last edit stands, or without one the first create or retry; a key whose last
    edit or delete is a delete is gone. A row with a null in its key has no name and stands for itself. Versions are
    unique; other columns are kept. The grouping combines before its shuffle, so copies of one key are no hot group.
    """
    rest = [c for c in log.columns if c not in key and c != op]
    nameless = F.when(reduce(or_, [F.col(c).isNull() for c in key]), F.col(version))
    did = F.lower(F.col(op)) if op else F.lit("create")
    later = did.isin("edit", "delete")
    rank = F.struct(F.coalesce(later, F.lit(False)).cast("int").alias("later"), F.when(later, F.col(version)).otherwise(-F.col(version)).alias("version"))
    state = F.max_by(F.struct(*rest, F.coalesce(did == "delete", F.lit(False)).alias("_deleted")), rank).alias("_state")
    folded = log.groupBy(*key, nameless.alias("_nameless")).agg(state).where("NOT _state._deleted")
    return folded.select(*key, *[F.col("_state")[c].alias(c) for c in rest])


def turns(records: DataFrame) -> DataFrame:
    """(session, at, source_file, line_num, rec_id, by_user, wrong): what speaks for or against each session.

    Rows are turns (type user or assistant, no tool_use_result, text not blank) and damaged block lists. wrong: damaged, of
    an unreadable time, or by a speaker other than its type. Rows without a session belong to no conversation.
    """
    speaks = F.coalesce(F.col("type").isin(*SPEAKERS), F.lit(False)) & F.col("tool_use_result").isNull()
    content = F.when(speaks, F.col("message.content"))
    role = F.lower(F.regexp_replace(F.col("message.role"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    speaker = F.when(F.coalesce(role, F.lit("")) == "", F.col("type")).otherwise(role)
    at = instant(F.col("timestamp"))
    small = with_text(records.where(F.col("rec_id").isNotNull()), content).select(
        "source_file",
        "line_num",
        "rec_id",
        "session",
        at.alias("at"),
        (F.col("type") == "user").alias("by_user"),
        F.col("damaged"),
        F.coalesce(~F.col("record_text").rlike(BLANK), F.lit(False)).alias("turn"),
        (at.isNull() | (speaker != F.col("type"))).alias("off"),
    )
    final = fold_log(small, ["source_file", "line_num"], "rec_id").where(F.col("session").isNotNull() & (F.col("turn") | F.col("damaged")))
    return final.select("session", *ORDER, "by_user", (F.col("damaged") | F.col("off")).alias("wrong"))


def conversations(records: DataFrame) -> DataFrame:
    """(session, opener_rec_id, step, rec_id): the turns of each whole session.

    A session is whole if its first turn is the user's and its last the assistant's, no user turn directly follows another,
    no turn has an unreadable time or a speaker other than its type, and no message of it is damaged. Turns are ordered by
    instant, source_file, line_num. opener_rec_id is the latest user turn at or before the turn, step counts from it.
    """
    spark = records.sparkSession
    laid = turns(records).repartitionByRange("session", *ORDER).withColumn("stretch", F.spark_partition_id())
    laid, _ = materialize(laid, f"{shared_dir(spark)}/turns")
    inside = Window.partitionBy("session", "stretch").orderBy(*ORDER)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        laid.withColumn("n", F.row_number().over(inside))
        .withColumn("doubled", F.coalesce(F.col("by_user") & F.lag("by_user").over(inside), F.lit(False)))
        .withColumn("opener", F.last(F.when(F.col("by_user"), F.struct("n", "rec_id")), ignorenulls=True).over(so_far))
    )
    stretches = rows.groupBy("session", "stretch").agg(
        F.count("*").alias("size"),
        F.bool_or(F.col("wrong") | F.col("doubled")).alias("broken"),
        F.min_by("by_user", "n").alias("starts"),
        F.max_by("by_user", "n").alias("ends"),
        F.max_by("opener", "n").alias("opened"),
    )
    across = Window.partitionBy("session").orderBy("stretch")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("session")
    carried = (
        stretches.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("opened_at", F.when(F.col("opened").isNotNull(), F.struct((F.col("before") + F.col("opened.n")).alias("n"), F.col("opened.rec_id").alias("rec_id"))))
        .withColumn("carry", F.last("opened_at", ignorenulls=True).over(earlier))
        .withColumn("bad", F.col("broken") | F.coalesce(F.lag("ends").over(across) & F.col("starts"), F.lit(False)))
        .withColumn("fine", ~F.bool_or("bad").over(whole) & F.min_by("starts", "stretch").over(whole) & ~F.max_by("ends", "stretch").over(whole))
        .where("fine")
        .select("session", "stretch", "before", "carry")
    )
    at = F.col("before") + F.col("n")
    here = F.struct((F.col("before") + F.col("opener.n")).alias("n"), F.col("opener.rec_id").alias("rec_id"))
    opened = F.when(F.col("opener").isNotNull(), here).otherwise(F.col("carry"))
    return rows.join(carried, ["session", "stretch"]).select("session", opened["rec_id"].alias("opener_rec_id"), (at - opened["n"]).cast("int").alias("step"), "rec_id")


def conversation_turns(records: DataFrame) -> DataFrame:
    """conversations() with each turn's speaker and text: (session, opener_rec_id, step, rec_id, role, text)."""
    texts = with_text(records.select("rec_id", "type", "message"), F.when(F.col("type").isin(*SPEAKERS), F.col("message.content")))
    return conversations(records).join(texts.select("rec_id", F.col("type").alias("role"), F.col("record_text").alias("text")), "rec_id")


def dropped_sessions(records: DataFrame) -> DataFrame:
    """(session, turns): the sessions that conversations() leaves out, the empty ones, without any turn, too."""
    kept = conversations(records).select("session").distinct()
    every = records.where(F.col("session").isNotNull()).select("session").distinct()
    counts = turns(records).groupBy("session").agg(F.count("*").alias("turns"))
    return every.join(kept, "session", "left_anti").join(counts, "session", "left").select("session", F.coalesce("turns", F.lit(0)).alias("turns"))

