"""Messages to batches: by pauses, by size, by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import back_to_parent, estimate_tokens, subtopic, topic_shift
from ..session import materialize, shared_dir
from .ordering import lay_out, running


def gap_batches(messages: DataFrame, seconds: float = 5.0, most: int = 100) -> DataFrame:
    """(source_file, line_num, rec_id, batch_line, place, tokens): messages with the first line of their batch and their size.

    In each file, by line number: a pause longer than so many seconds starts a batch, and so does every message after `most`
    others. Time running backwards is no pause, and neither is a message without a readable time: the next one is held against
    the last time that was read. Messages without a file are one group.
    """
    by, order = ["source_file"], ["line_num", "rec_id"]
    rows = messages.select("source_file", "line_num", "rec_id", F.unix_micros("sent_at").alias("at"), estimate_tokens(F.col("content")).alias("tokens"))
    laid = lay_out(rows, by, order)
    placed = running(laid, by, order, sums={"place": F.lit(1)}, lasts={"read": F.col("at")})
    timed = running(placed, by, order, before={"earlier": F.col("read")})
    starts = (F.col("place") == 1) | (F.col("at") - F.col("earlier") > seconds * 1_000_000)
    marked = running(timed, by, order, lasts={"run": F.when(starts, F.col("place"))})
    batch = F.col("run") + F.floor((F.col("place") - F.col("run")) / most) * most
    found = marked.select("source_file", "line_num", "rec_id", "place", batch.alias("batch"), "tokens")
    first = found.where("place = batch").select(F.col("source_file").alias("of"), F.col("batch").alias("begun"), F.col("line_num").alias("batch_line"))
    joined = found.join(first, F.col("source_file").eqNullSafe(F.col("of")) & (F.col("batch") == F.col("begun")))
    return joined.select("source_file", "line_num", "rec_id", "batch_line", "place", "tokens")


def batch_sizes(batches: DataFrame) -> DataFrame:
    """(source_file, batch_line, messages, tokens) of each batch; messages without a file belong to no file's batches."""
    named = batches.where(F.col("source_file").isNotNull())
    return named.groupBy("source_file", "batch_line").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def token_packs(sizes: DataFrame, most: int = 6000) -> DataFrame:
    """(source_file, batch_line, pack_line): batches packed greedily, in order, into packs of at most so many tokens.

    A pack ends before the batch that would take it over; a larger batch is a pack of its own. Where a pack that started at
    each batch would end is one ordered pass over the running totals; the starts that are reached from the first batch are
    then found by following these jumps in doubling steps. No file is folded in one task.
    """
    spark, by = sizes.sparkSession, ["source_file"]
    base = shared_dir(spark)
    laid = lay_out(sizes.select("source_file", "batch_line", "tokens"), by, ["batch_line"])
    totals, _ = materialize(running(laid, by, ["batch_line"], sums={"upto": F.col("tokens"), "place": F.lit(1)}).drop("_stretch"), f"{base}/totals")
    # Ordered by running total: the first batch whose total passes a start's limit is the next start.
    ends = totals.select("source_file", F.col("upto").alias("x"), F.lit(1).alias("kind"), F.col("place").alias("p"))
    limits = totals.select("source_file", (F.col("upto") - F.col("tokens") + most).alias("x"), F.lit(0).alias("kind"), F.col("place").alias("p"))
    order = ["down", "kind", "q"]
    both = ends.unionByName(limits).withColumn("down", -F.col("x")).withColumn("q", -F.col("p"))
    seen = running(lay_out(both, by, order), by, order, lasts={"next": F.when(F.col("kind") == 1, F.col("p"))})
    jumps = seen.where("kind = 0 AND next IS NOT NULL").select("source_file", F.col("p").alias("place"), F.greatest("next", F.col("p") + 1).alias("next"))
    last = totals.groupBy("source_file").agg(F.max("place").alias("last"))
    jumps, _ = materialize(jumps.join(last, "source_file").where("next <= last").select("source_file", "place", "next"), f"{base}/jumps=0")
    starts, got = materialize(totals.where("place = 1").select("source_file", "place"), f"{base}/starts=0", n=F.count("*"))
    step, n = 0, -1
    while got["n"] != n:
        n, step = got["n"], step + 1
        reached = starts.join(jumps, ["source_file", "place"]).select("source_file", F.col("next").alias("place"))
        starts, got = materialize(starts.unionByName(reached).distinct(), f"{base}/starts={step}", n=F.count("*"))
        twice = jumps.join(jumps.select("source_file", F.col("place").alias("next"), F.col("next").alias("then")), ["source_file", "next"])
        jumps, _ = materialize(twice.select("source_file", "place", F.col("then").alias("next")), f"{base}/jumps={step}")
    marked = totals.join(starts.withColumn("is_start", F.lit(True)), ["source_file", "place"], "left")
    packed = running(lay_out(marked, by, ["batch_line"]), by, ["batch_line"], lasts={"pack_line": F.when(F.col("is_start"), F.col("batch_line"))})
    return packed.select("source_file", "batch_line", "pack_line")


def topic_turns(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, rec_id, turn): what each message does to the topic: back, deeper, shift or none; the first that fits."""
    c = F.col("content")
    return messages.select(*(keep or []), "rec_id", F.when(back_to_parent(c), "back").when(subtopic(c), "deeper").when(topic_shift(c), "shift").otherwise("none").alias("turn"))


def semantic_shift(rows: DataFrame, threshold: float = 0.55, rule: str = "gradual") -> DataFrame:
    """(session, id, shift): where the topic shifts, from the similarity of each idea to its span (session, at, id, similarity).

    gradual: below the threshold by 0.15, or below it twice in the last three including this one. three: below it three times
    running. Places without a similarity don't count.
    """
    by, order = ["session"], ["at", "id"]
    laid = lay_out(rows.where(F.col("similarity").isNotNull()), by, order)
    one = running(laid, by, order, before={"s1": F.col("similarity")})
    two = running(one, by, order, before={"s2": F.col("s1")})
    low = lambda c: F.coalesce(F.col(c) < threshold, F.lit(False))
    if rule == "three":
        shift = low("similarity") & low("s1") & low("s2")
    else:
        shift = (F.col("similarity") < threshold - 0.15) | (low("similarity") & (low("s1") | low("s2")))
    return two.select("session", "id", shift.alias("shift"))
