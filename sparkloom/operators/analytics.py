"""Counts, timelines and reviews over the memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import micros, period_key
from .memory import spans, visible, when_said, with_topic

KEY_INTENTS = ("decision", "conclusion", "solution")


def list_topics(topics: DataFrame, span_rows: DataFrame, ideas: DataFrame) -> DataFrame:
    """(id, name, span_count, idea_count) of every topic. Ideas are counted by span before any join, topics last."""
    by_span = ideas.where(F.col("span_id").isNotNull()).groupBy(F.col("span_id").alias("id")).agg(F.count("*").alias("ideas"))
    by_topic = spans(span_rows).join(by_span, "id", "left").groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("span_count"), F.coalesce(F.sum("ideas"), F.lit(0)).alias("idea_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return topics.select("id", "name").join(by_topic, "id", "left").select("id", "name", zero("span_count"), zero("idea_count"))


def list_projects(projects: DataFrame, topics: DataFrame, span_rows: DataFrame, ideas: DataFrame) -> DataFrame:
    """(id, name, topic_count, idea_count) of every project, and under a null id of what has none."""
    counted = list_topics(topics, span_rows, ideas).select("id", "idea_count").join(topics.select("id", "project_id"), "id")
    by_project = counted.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("topic_count"), F.sum("idea_count").alias("idea_count"))
    named = projects.select("id", "name")
    both = by_project.join(named, by_project.id.eqNullSafe(named.id), "full")
    return both.select(F.coalesce(named.id, by_project.id).alias("id"), F.coalesce(named.name, F.lit("(Unassigned)")).alias("name"), F.coalesce("topic_count", F.lit(0)).alias("topic_count"), F.coalesce("idea_count", F.lit(0)).alias("idea_count"))


def list_sessions(ideas: DataFrame, span_rows: DataFrame) -> DataFrame:
    """(session, span_count, idea_count, first_us, last_us) of every session with spans or ideas."""
    a = ideas.where(F.col("session").isNotNull()).groupBy("session").agg(F.count("*").alias("idea_count"), F.min(micros(when_said())).alias("first_us"), F.max(micros(when_said())).alias("last_us"))
    b = spans(span_rows).where(F.col("session").isNotNull()).groupBy("session").agg(F.count("*").alias("span_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "session", "full").select("session", zero("span_count"), zero("idea_count"), "first_us", "last_us")


def totals(ideas: DataFrame, span_rows: DataFrame, topics: DataFrame, relations: DataFrame) -> DataFrame:
    """(section, name, n): the memory's counts. All of one table's counts come from one scan of it."""
    i = ideas.agg(
        F.count("*").alias("all"),
        F.count_if(F.coalesce(F.col("forgotten"), F.lit(False))).alias("forgotten"),
        F.count_if((F.col("intent") == "question") & ~F.coalesce(F.col("answered"), F.lit(False))).alias("unanswered"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("accesses"),
        F.count_if(F.coalesce(F.col("access_count"), F.lit(0)) == 0).alias("never_accessed"),
        F.count_if(F.col("access_count") > 5).alias("often_accessed"),
    )
    names = ["all", "forgotten", "unanswered", "accesses", "never_accessed", "often_accessed"]
    one = i.select(F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n).cast("bigint"))]).alias("name", "n"))
    group = lambda df, section, c: df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("tables").alias("section"), F.lit(name).alias("name"), "n")
    out = one.select(F.lit("ideas").alias("section"), "name", "n")
    for part in (group(ideas, "intent", "intent"), group(relations, "relation", "relation_type"), count(spans(span_rows), "spans"), count(topics, "topics")):
        out = out.unionByName(part)
    return out


def key_ideas(ideas: DataFrame, by: list[str], most: int = 3, width: int = 100) -> DataFrame:
    """(by, place, idea_id, intent, content): up to `most` decisions, conclusions and solutions of each group, in this order,
    by confidence, then id. Spark cuts every group to `most` before its shuffle."""
    kind = F.when(F.col("intent") == "decision", 1).when(F.col("intent") == "conclusion", 2).otherwise(3)
    w = Window.partitionBy(*by).orderBy(kind, F.desc_nulls_last("confidence"), "id")
    rows = ideas.where(F.col("intent").isin(*KEY_INTENTS)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return rows.select(*by, "place", F.col("id").alias("idea_id"), "intent", F.substring("content", 1, width).alias("content"))


def activity(ideas: DataFrame, period: str) -> DataFrame:
    """(period, total, decisions, questions, conclusions, sessions) of visible ideas."""
    n = lambda intent: F.count_if(F.col("intent") == intent)
    rows = visible(ideas).withColumn("period", period_key(when_said(), period)).where(F.col("period").isNotNull())
    return rows.groupBy("period").agg(F.count("*").alias("total"), n("decision").alias("decisions"), n("question").alias("questions"), n("conclusion").alias("conclusions"), F.countDistinct("session").alias("sessions"))


def activity_by_intent(ideas: DataFrame, period: str) -> DataFrame:
    rows = visible(ideas).withColumn("period", period_key(when_said(), period)).where(F.col("period").isNotNull())
    return rows.groupBy("period", "intent").agg(F.count("*").alias("n"))


def topic_activity(ideas: DataFrame, span_rows: DataFrame, period: str) -> DataFrame:
    """(topic_id, period, total, decisions, sessions) of visible ideas with a topic."""
    rows = with_topic(visible(ideas), span_rows).where(F.col("topic_id").isNotNull()).withColumn("period", period_key(when_said(), period))
    return rows.groupBy("topic_id", "period").agg(F.count("*").alias("total"), F.count_if(F.col("intent") == "decision").alias("decisions"), F.countDistinct("session").alias("sessions"))


def topic_timeline(topics: DataFrame, span_rows: DataFrame, ideas: DataFrame) -> DataFrame:
    """(topic_id, date, span_id, span_name, idea_count): the spans of each topic by the day they started."""
    by_span = ideas.where(F.col("span_id").isNotNull()).groupBy("span_id").agg(F.count("*").alias("idea_count"))
    rows = spans(span_rows).join(topics.select(F.col("id").alias("topic_id")), "topic_id")
    day = period_key(F.coalesce("start_time", "created_at").cast("timestamp"), "day")
    return rows.select("topic_id", day.alias("date"), F.col("id").alias("span_id"), F.col("name").alias("span_name")).join(by_span, "span_id", "left").select("topic_id", "date", "span_id", "span_name", F.coalesce("idea_count", F.lit(0)).alias("idea_count"))


def project_timeline(ideas: DataFrame, span_rows: DataFrame, days: int | None = None, now=None) -> DataFrame:
    """(session, date, ideas, decisions, topics) by session and day; with days, only the last so many up to now."""
    rows = with_topic(visible(ideas), span_rows)
    if days is not None:
        rows = rows.where(when_said() >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return rows.groupBy("session", period_key(when_said(), "day").alias("date")).agg(F.count("*").alias("ideas"), F.count_if(F.col("intent") == "decision").alias("decisions"), F.countDistinct("topic_id").alias("topics"))


def review_topics(topics: DataFrame, span_rows: DataFrame, ideas: DataFrame, catch_all: int = 100, share: float = 0.2) -> DataFrame:
    """(id, name, idea_count, is_catch_all, bad_name, is_empty, duplicates): what may be wrong with each topic.

    duplicates is the number of other topics whose cleaned name is the same.
    """
    counted = list_topics(topics, span_rows, ideas)
    whole = counted.agg(F.sum("idea_count").alias("whole"))
    key = tx.canonical_topic(tx.clean_topic_name(F.col("name")))
    same = counted.groupBy(key.alias("other_key")).agg((F.count("*") - 1).alias("duplicates"))
    large = (F.col("idea_count") > catch_all) | (F.col("idea_count") > F.col("whole") * share)
    rows = counted.crossJoin(F.broadcast(whole)).withColumn("key", key).join(same, F.col("key").eqNullSafe(F.col("other_key")), "left")
    return rows.select("id", "name", "idea_count", F.coalesce(large, F.lit(False)).alias("is_catch_all"), tx.review_topic_name(F.col("name")).alias("bad_name"), (F.col("idea_count") == 0).alias("is_empty"), "duplicates")


def topic_history(span_rows: DataFrame, ideas: DataFrame) -> DataFrame:
    """(session, span_id, name, start_line, end_line, idea_count, is_return): spans of each session; is_return where an
    earlier span of the session, by start line, has the same name."""
    by_span = ideas.where(F.col("span_id").isNotNull()).groupBy("span_id").agg(F.count("*").alias("idea_count"))
    rows = spans(span_rows).withColumn("key", F.substring(F.trim(F.lower(F.coalesce("name", F.lit("")))), 1, 30))
    # The first span of each name is found by an aggregate that combines before its shuffle, whatever the session's size.
    first = rows.where("key <> ''").groupBy(F.col("session").alias("of"), F.col("key").alias("same")).agg(F.min(F.struct("start_line", "id"))["id"].alias("first"))
    joined = rows.join(first, F.col("session").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same")), "left")
    out = joined.select("session", F.col("id").alias("span_id"), "name", "start_line", "end_line", (F.coalesce(F.col("first"), F.col("id")) != F.col("id")).alias("is_return"))
    return out.join(by_span, "span_id", "left").select("session", "span_id", "name", "start_line", "end_line", F.coalesce("idea_count", F.lit(0)).alias("idea_count"), "is_return")


def unanswered_questions(ideas: DataFrame) -> DataFrame:
    rows = visible(ideas).where((F.col("intent") == "question") & ~F.coalesce(F.col("answered"), F.lit(False)))
    return rows.select("id", "session", "content", micros(when_said()).alias("said_us"))


def open_spans(span_rows: DataFrame) -> DataFrame:
    """(session, span_id, depth): the deepest, newest open span of each session."""
    rows = spans(span_rows).where(F.col("end_line").isNull() & F.col("session").isNotNull())
    return rows.groupBy("session").agg(F.max(F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "id")).alias("top")).select("session", F.col("top.id").alias("span_id"), F.col("top.depth").alias("depth"))


def reflection(ideas: DataFrame, now, days: int = 7, most: int = 5, width: int = 150) -> DataFrame:
    """(session, intent, place, n, content): of the last days before now, per session and intent the count and first ideas."""
    recent = visible(ideas).where(when_said() >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    counts = recent.groupBy("session", "intent").agg(F.count("*").alias("n"))
    w = Window.partitionBy("session", "intent").orderBy(when_said(), "id")
    first = recent.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("session", "intent", "place", F.substring("content", 1, width).alias("content"))
    counts = counts.select(F.col("session").alias("of"), F.col("intent").alias("kind"), "n")
    return first.join(counts, F.col("session").eqNullSafe(F.col("of")) & F.col("intent").eqNullSafe(F.col("kind"))).select("session", "intent", "place", "n", "content")


def topic_key_ideas(ideas: DataFrame, span_rows: DataFrame, period: str, most: int = 3) -> DataFrame:
    """key_ideas() of each topic and period: (topic_id, period, place, idea_id, intent, content)."""
    rows = with_topic(visible(ideas), span_rows).where(F.col("topic_id").isNotNull()).withColumn("period", period_key(when_said(), period))
    return key_ideas(rows, ["topic_id", "period"], most)


def recent(ideas: DataFrame, now, days: int) -> DataFrame:
    """The ideas of the last days before now."""
    return ideas.where(when_said() >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def after_session(ideas: DataFrame, session: str | Column) -> DataFrame:
    """The ideas said after the last one of a session; all of them if there is no such session."""
    end = ideas.where(F.col("session") == session).agg(F.max(when_said()).alias("_end"))
    return ideas.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (when_said() > F.col("_end"))).select(ideas.columns)


def top_accessed(ideas: DataFrame, most: int = 5) -> DataFrame:
    """(id, access_count): the ideas looked at most."""
    return ideas.where(F.col("access_count") > 0).orderBy(F.desc("access_count"), "id").limit(most).select("id", "access_count")


def latest_spans(span_rows: DataFrame) -> DataFrame:
    """(session, span_id): the span of each session that starts last, of several the one of the greatest id."""
    rows = spans(span_rows).where(F.col("session").isNotNull())
    return rows.groupBy("session").agg(F.max(F.struct("start_line", "id"))["id"].alias("span_id"))
