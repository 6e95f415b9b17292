"""Scoring, forgetting, folding and rewriting. Every change is a function from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bad_topic_name, canonical_topic, clean_topic_name
from .memory import PROTECTED, importance, should_preserve, spans, visible, when_said, with_topic
from .ordering import numbered


def age_days(now: Column, stamp: Column) -> Column:
    """Whole days from a time to now."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / 86_400_000_000)


def retention_score(now: Column) -> Column:
    """0 to 1: 0.3 by recency (1 falling to 0.2 over 90 days), 0.3 by accesses (5 are full), 0.4 by intent; three places."""
    created = F.coalesce("created_at", "message_time")
    age = F.least(F.coalesce(age_days(now, created), F.lit(0)), F.lit(365))
    recency = F.greatest(F.lit(0.2), 1.0 - age / 90 * 0.8)
    access = F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / 5)
    return F.round(recency * 0.3 + access * 0.3 + importance(F.coalesce("intent", F.lit("context"))) * 0.4, 3)


def forgettable(ideas: DataFrame, now: Column, threshold: float) -> DataFrame:
    """(id, session, score): visible ideas at or below a retention score, without protected intents and without any."""
    rows = visible(ideas).where(~F.col("intent").isin(*PROTECTED)).withColumn("score", retention_score(now))
    return rows.where(F.col("score") <= threshold).select("id", "session", "score")


def mark_forgotten(ideas: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    """ideas with forgotten set on the given ids."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return ideas.join(hit, "id", "left").withColumn("forgotten", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("forgotten"))).select(ideas.columns)


def consolidation(ideas: DataFrame, span_rows: DataFrame, now: Column, days: int = 7, least: int = 3) -> DataFrame:
    """(topic_id, n, mean_confidence): topics with enough visible, old, unprotected ideas to be summed up."""
    rows = with_topic(visible(ideas), span_rows).where(F.col("topic_id").isNotNull() & (age_days(now, F.col("created_at")) >= days) & ~should_preserve(F.col("intent"), F.col("confidence")))
    return rows.groupBy("topic_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("mean_confidence")).where(F.col("n") >= least)


def consolidate(ideas: DataFrame, span_rows: DataFrame, now: Column, days: int = 7, least: int = 3, most: int = 5) -> DataFrame:
    """(topic_id, content, sources): for each topic to be summed up, its first ideas as text and the number it stands for.

    The text is extractive; another summariser takes the same rows. Only `most` ideas of a topic are ever collected.
    """
    topics = consolidation(ideas, span_rows, now, days, least).select("topic_id", F.col("n").alias("sources"))
    rows = with_topic(visible(ideas), span_rows).where((age_days(now, F.col("created_at")) >= days) & ~should_preserve(F.col("intent"), F.col("confidence")))
    w = Window.partitionBy("topic_id").orderBy(when_said(), "id")
    first = rows.join(topics, "topic_id").withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.substring("content", 1, 100).alias("c")))), lambda x: x["c"]), " | ")
    return first.groupBy("topic_id").agg(text.alias("content"), F.first("sources").alias("sources"))


def fold_activation(mentions: DataFrame, step: float = 0.5) -> DataFrame:
    """(session, idea_id, activation, mentions): 1 at the first mention, step more for each later one, never above 1."""
    rows = mentions.groupBy("session", "idea_id").agg(F.count("*").alias("mentions"))
    return rows.select("session", "idea_id", F.least(F.lit(1.0), 1.0 + step * (F.col("mentions") - 1)).alias("activation"), "mentions")


def access_deltas(hits: DataFrame, ideas: DataFrame, step: float = 0.2) -> DataFrame:
    """(id, access_count, activation): what showing result lists does: one access and step of activation for each showing."""
    shown = hits.groupBy("id").agg(F.count("*").alias("n"))
    return ideas.join(shown, "id").select("id", (F.coalesce("access_count", F.lit(0)) + F.col("n")).alias("access_count"), F.round(F.least(F.lit(1.0), step * F.col("n")), 6).alias("activation"))


def decay(activation: DataFrame, rate: float = 0.9, least: float = 0.01) -> DataFrame:
    """activation times rate, without what falls below least."""
    return activation.withColumn("activation", F.col("activation") * rate).where(F.col("activation") >= least)


def working_memory(ideas: DataFrame, now: Column, rate: float = 0.5, least: float = 0.01) -> DataFrame:
    """(session, idea_id, activation): ideas by use: 0.2 for each access up to 1, halved for each day since the last."""
    days = age_days(now, F.col("last_accessed"))
    start = F.least(F.lit(1.0), 0.2 * F.col("access_count"))
    rows = visible(ideas).where(F.col("last_accessed").isNotNull()).select("session", F.col("id").alias("idea_id"), F.round(start * F.pow(F.lit(rate), days), 9).alias("activation"))
    return rows.where(F.col("activation") >= least)


def active(activation: DataFrame, most: int, least: float = 0.1) -> DataFrame:
    """The `most` most active ideas of each session, ties by id."""
    w = Window.partitionBy("session").orderBy(F.desc("activation"), "idea_id")
    return activation.where(F.col("activation") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def distinct_ideas(ideas: DataFrame) -> DataFrame:
    """(source_file, source_line, id, copies): one id for each place in a transcript, the smallest."""
    rows = ideas.where(F.col("source_file").isNotNull() & F.col("source_line").isNotNull())
    return rows.groupBy("source_file", "source_line").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def find_or_create_topics(span_rows: DataFrame, topics: DataFrame) -> DataFrame:
    """(span_id, topic_id, canonical_name, is_new): the topic of each span's name, by canonical name. New topics get ids after
    the last, in the order of their names."""
    names = spans(span_rows).where(F.length(F.coalesce("name", F.lit(""))) > 0).select(F.col("id").alias("span_id"), canonical_topic(F.col("name")).alias("canonical_name"))
    known = topics.where(F.col("canonical_name").isNotNull()).groupBy("canonical_name").agg(F.min("id").alias("topic_id"))
    fresh = names.select("canonical_name").distinct().join(known, "canonical_name", "left_anti")
    made = numbered(fresh.withColumn("_all", F.lit(0)), ["_all"], ["canonical_name"]).crossJoin(F.broadcast(topics.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))))
    every = known.withColumn("is_new", F.lit(False)).unionByName(made.select("canonical_name", (F.col("_top") + F.col("place")).alias("topic_id"), F.lit(True).alias("is_new")))
    return names.join(every, "canonical_name").select("span_id", "topic_id", "canonical_name", "is_new")


def merge_topics(span_rows: DataFrame, topics: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spans and topics after each pair's source topic went into its target; pairs is (source, target), sources unique."""
    to = pairs.select(F.col("source").alias("topic_id"), "target")
    moved = span_rows.join(to, "topic_id", "left").withColumn("topic_id", F.coalesce("target", "topic_id")).select(span_rows.columns)
    return moved, topics.join(pairs.select(F.col("source").alias("id")), "id", "left_anti")


def delete_cascade(ideas: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ideas and relations without the given ideas and what hangs on them."""
    gone = ids.select("id").distinct()
    left = relations.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return ideas.join(gone, "id", "left_anti"), left.select(relations.columns)


def topic_times(topics: DataFrame, span_rows: DataFrame) -> DataFrame:
    """(id, first_seen, last_seen): times of each topic's spans, and its own where it has none."""
    seen = spans(span_rows).groupBy(F.col("topic_id").alias("id")).agg(F.min("start_time").alias("a"), F.max(F.coalesce("end_time", "start_time")).alias("b"))
    return topics.join(seen, "id", "left").select("id", F.coalesce("a", "first_seen").alias("first_seen"), F.coalesce("b", "last_seen").alias("last_seen"))


def consolidated(ideas: DataFrame, span_rows: DataFrame, now: Column, days: int = 7, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """ideas with consolidated_into, and the summaries (id, topic_id, content, confidence, sources) that they went into.

    Each topic to be summed up gets one summary under an id after the last, in the order of the topics.
    """
    top = F.broadcast(ideas.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    made = numbered(consolidate(ideas, span_rows, now, days, least).withColumn("_all", F.lit(0)), ["_all"], ["topic_id"]).crossJoin(top)
    made = made.select((F.col("_top") + F.col("place")).alias("id"), "topic_id", "content", F.lit(0.8).alias("confidence"), "sources")
    old = (age_days(now, F.col("created_at")) >= days) & ~should_preserve(F.col("intent"), F.col("confidence"))
    gone = with_topic(visible(ideas).where(old), span_rows).join(made.select("topic_id", F.col("id").alias("consolidated_into")), "topic_id").select("id", "consolidated_into")
    return ideas.drop("consolidated_into").join(gone, "id", "left"), made


def delete_topics(span_rows: DataFrame, ideas: DataFrame, topics: DataFrame, ids: DataFrame, with_ideas: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """spans, ideas and topics without the given topics (id): their spans belong to no topic, and with_ideas their ideas go."""
    gone = ids.select(F.col("id").alias("topic_id"), F.lit(True).alias("_gone")).distinct()
    left = span_rows.join(gone, "topic_id", "left").withColumn("topic_id", F.when(F.col("_gone").isNull(), F.col("topic_id"))).select(span_rows.columns)
    if with_ideas:
        of = spans(span_rows).join(gone, "topic_id", "left_semi").select(F.col("id").alias("span_id"))
        ideas = ideas.join(of, "span_id", "left_anti").select(ideas.columns)
    return left, ideas, topics.join(ids, "id", "left_anti")


def prune_old(ideas: DataFrame, relations: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """ideas and relations without the ideas older than so many days, decisions and conclusions among them too."""
    old = ideas.where(age_days(now, F.coalesce("message_time", "created_at")) > days)
    return delete_cascade(ideas, relations, old)


def merge_spans(span_rows: DataFrame, ideas: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spans and ideas after each pair's source span went into its target; pairs is (source, target), sources unique and no
    target a source. Ideas and children of a source go to its target; a target that was below its source takes its place."""
    to = pairs.select("source", "target")
    up = span_rows.join(to.withColumnRenamed("target", "_up"), F.col("parent_id") == F.col("source"), "left").withColumn("parent_id", F.coalesce("_up", "parent_id")).drop("source", "_up")
    up = up.withColumn("parent_id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")))
    left = up.join(to.select(F.col("source").alias("id")), "id", "left_anti").select(span_rows.columns)
    moved = ideas.join(to, F.col("span_id") == F.col("source"), "left").withColumn("span_id", F.coalesce("target", "span_id")).select(ideas.columns)
    return left, moved


def same_spans(span_rows: DataFrame) -> DataFrame:
    """(source, target): the spans of a session with a name that an earlier id of the session has, and that id."""
    rows = spans(span_rows).where(F.col("session").isNotNull()).withColumn("key", F.trim(F.lower("name"))).where(F.length("key") > 0)
    first = rows.groupBy("session", "key").agg(F.min("id").alias("target"))
    return rows.join(first, ["session", "key"]).where(F.col("id") != F.col("target")).select(F.col("id").alias("source"), "target")


def answered(ideas: DataFrame, relations: DataFrame) -> DataFrame:
    """ideas with answered set on the questions that a visible idea answers."""
    by = visible(ideas).select(F.col("id").alias("from_id"))
    hit = relations.where("relation_type = 'answers'").join(by, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    now = (F.col("intent") == "question") & F.col("_hit")
    return ideas.join(hit, "id", "left").withColumn("answered", F.when(now, True).otherwise(F.col("answered"))).select(ideas.columns)


def store_ideas(ideas: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows of fresh that become ideas: those at a place (source_file, source_line) that no idea has, of several at one
    place the smallest id. Rows without a place are all stored."""
    place = ["source_file", "source_line"]
    there = F.col("source_file").isNotNull() & F.col("source_line").isNotNull()
    first = fresh.where(there).groupBy(*place).agg(F.min("id").alias("id")).join(ideas.where(there).select(*place).distinct(), place, "left_anti")
    return fresh.where(there).join(first.select("id"), "id", "left_semi").unionByName(fresh.where(~there))


def topic_names(messages: DataFrame, fallback: str = "Discussion", width: int = 200) -> DataFrame:
    """(session, name): a topic name for each session from the head of its first message, by time (none last), file and line;
    `fallback` where that makes none. The first message is kept by an aggregate."""
    at = F.struct(F.col("sent_at").isNull().alias("late"), "sent_at", "source_file", "line_num", "rec_id")
    head = F.min_by(F.substring("content", 1, width), at).alias("head")
    named = messages.where(F.col("session").isNotNull()).groupBy("session").agg(head).select("session", clean_topic_name(F.col("head")).alias("name"))
    return named.select("session", F.when(~bad_topic_name(F.col("name")), F.col("name")).otherwise(F.lit(fallback)).alias("name"))
