"""What surrounds a span: its ancestors, its text for embedding, its summary; and searches that go on into linked topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .clusters import centroids, topic_ideas
from .hierarchy import hierarchy
from .memory import spans, visible, when_said, with_topic
from .nearest import usable, within


def ancestor_context(span_rows: DataFrame) -> DataFrame:
    """(id, place, ancestor_id, name): each span's chain of parents, root first, the span itself last; none on circles."""
    found = hierarchy(span_rows).where("loop_id = 0")
    chain = found.select("id", F.posexplode(F.split("path", "/")).alias("place", "a")).select("id", "place", F.col("a").cast("bigint").alias("ancestor_id"))
    return chain.join(spans(span_rows).select(F.col("id").alias("ancestor_id"), "name"), "ancestor_id").select("id", "place", "ancestor_id", "name")


def reparent(span_rows: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans after moves (id, parent_id; ids unique), and the moves refused because they would close a circle."""

    def moved(pairs: DataFrame) -> DataFrame:
        to = pairs.select("id", F.col("parent_id").alias("_to"), F.lit(True).alias("_moved"))
        return span_rows.join(to, "id", "left").withColumn("parent_id", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("parent_id"))).select(span_rows.columns)

    circles = hierarchy(moved(moves)).where("loop_id > 0").select("id")
    refused = moves.join(circles, "id", "left_semi")
    return moved(moves.join(circles, "id", "left_anti")), refused


def span_summaries(span_rows: DataFrame, ideas: DataFrame, least: int = 30, width: int = 200) -> DataFrame:
    """(id, summary): the first sentence of each span's first idea longer than `least` characters; 'Brief discussion' if none."""
    long = ideas.where((F.char_length("content") > least) & F.col("span_id").isNotNull())
    first = long.groupBy(F.col("span_id").alias("id")).agg(F.min(F.struct(when_said().alias("t"), F.col("id").alias("i"), F.col("content").alias("c"))).alias("f"))
    text = F.substring(F.get(F.split(F.col("f.c"), r"(?<=[.!?])\s"), F.lit(0)), 1, width)
    return spans(span_rows).select("id").join(first, "id", "left").select("id", F.coalesce(text, F.lit("Brief discussion")).alias("summary"))


def span_texts(span_rows: DataFrame, ideas: DataFrame, ends: int = 3, most: int = 5, width: int = 200, size: int = 2000) -> DataFrame:
    """(id, text): name, summary and key points of each span, as embedded: its first and last ideas, at most five.

    Each span's rows are cut to its ends before they are collected.
    """
    up = Window.partitionBy("span_id").orderBy(when_said(), "id")
    down = Window.partitionBy("span_id").orderBy(when_said().desc(), F.desc("id"))
    rows = visible(ideas).where(F.col("span_id").isNotNull()).select("span_id", "id", "message_time", "created_at", F.substring("content", 1, width).alias("c"))
    cut = lambda w: rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= ends).select("span_id", "id", when_said().alias("t"), "c")
    both = cut(up).unionByName(cut(down)).distinct()
    points = F.slice(F.array_sort(F.collect_list(F.struct("t", "id", "c"))), 1, most)
    by_span = both.groupBy(F.col("span_id").alias("id")).agg(F.array_join(F.transform(points, lambda p: p["c"]), "; ").alias("points"))
    text = F.concat_ws(" | ", "name", "summary", F.concat(F.lit("Key points: "), F.col("points")))
    return spans(span_rows).select("id", "name", "summary").join(by_span, "id", "left").select("id", F.substring(text, 1, size).alias("text"))


def span_vectors(ideas: DataFrame, dim: int = 64) -> DataFrame:
    """(id, v): mean vector of each span's visible ideas."""
    rows = visible(ideas).where(F.col("span_id").isNotNull())
    return centroids(usable(rows, "id", "embedding", dim).join(rows.select("id", "span_id"), "id"), "span_id", dim).select(F.col("span_id").alias("id"), "v")


def related_topics(ideas: DataFrame, span_rows: DataFrame, least: float = 0.8, k: int = 5, dim: int = 64) -> DataFrame:
    """(query_id, rank, id, score): for each topic's mean vector the other topics whose nearest span is at least this similar,
    at most k, by that similarity, then id. Of a topic's spans the nearest is kept by an aggregate before anything is ranked."""
    points = centroids(topic_ideas(ideas, span_rows, dim), "topic_id", dim).select(F.col("topic_id").alias("id"), "v")
    owners = spans(span_rows).where(F.col("topic_id").isNotNull()).select("id", "topic_id")
    rows = span_vectors(ideas, dim).join(owners, "id").select(F.col("topic_id").alias("id"), "v")
    near = within(points, rows, least, dim).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def topic_expansion(ideas: DataFrame, span_rows: DataFrame, least: float = 0.8, topics: int = 5, k: int = 10, dim: int = 64) -> DataFrame:
    """(query_id, rank, id, topic_id, score): for each topic, the ideas of its most similar other topics nearest to it.

    A topic's ideas meet only the topics that link to it, at most so many for each asking topic.
    """
    rows = topic_ideas(ideas, span_rows, dim)
    points = centroids(rows, "topic_id", dim).select(F.col("topic_id").alias("id"), "v")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    links = within(points, points, least, dim).withColumn("n", F.row_number().over(w)).where(F.col("n") <= topics).select("query_id", F.col("id").alias("topic_id"))
    asked = links.join(points.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = rows.join(asked, "topic_id").select("query_id", "id", "topic_id", F.round(cosine(F.col("v"), F.col("q")), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "topic_id", "score")


def span_similarity(ideas: DataFrame, dim: int = 64) -> DataFrame:
    """(id, session, at, span_id, similarity): cosine, to nine places, of each visible idea with its span's mean vector."""
    rows = visible(ideas).where(F.col("span_id").isNotNull())
    own = usable(rows, "id", "embedding", dim).join(rows.select("id", "session", "span_id", when_said().alias("at")), "id")
    means = span_vectors(ideas, dim).select(F.col("id").alias("span_id"), F.col("v").alias("mean"))
    return own.join(means, "span_id").select("id", "session", "at", "span_id", F.round(cosine(F.col("v"), F.col("mean")), 9).alias("similarity"))


def told(ideas: DataFrame, by: str, order: list, line: Column, most: int, between: str = "\n") -> DataFrame:
    """(by, text): the first `most` rows of each group in order, as lines. A group is cut before it is gathered."""
    w = Window.partitionBy(by).orderBy(*order)
    first = ideas.where(F.col(by).isNotNull()).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most).select(by, "_at", line.alias("_line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"])
    return first.groupBy(by).agg(F.array_join(lines, between).alias("text"))


def topic_reflection(ideas: DataFrame, span_rows: DataFrame, most: int = 30, width: int = 150) -> DataFrame:
    """(topic_id, text): the first ideas of each topic as a timeline, one line each, for a text model to reflect on."""
    line = F.concat(F.lit("- ["), F.coalesce("intent", F.lit("context")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, width))
    return told(with_topic(visible(ideas), span_rows), "topic_id", [when_said(), "id"], line, most)


def span_texts_confident(span_rows: DataFrame, ideas: DataFrame, most: int = 10, size: int = 2000) -> DataFrame:
    """(id, text): name and most confident ideas of each span, one a line, as embedded."""
    points = told(visible(ideas), "span_id", [F.desc_nulls_last("confidence"), "id"], F.coalesce("content", F.lit("")), most)
    rows = spans(span_rows).select("id", "name").join(points.select(F.col("span_id").alias("id"), F.col("text").alias("points")), "id", "left")
    return rows.select("id", F.substring(F.concat_ws("\n", "name", "points"), 1, size).alias("text"))
