"""Changes of the memory's tables, each shown by what it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle, records
from ..session import table
from .insights import _CONS, _OLD, _PRESERVE, _WM, NOW
from .retrieval import _KNN10, _ROWS, knn_ideas
from .shared import SEEN, SPANS, TOPICAL, VISIBLE

LATER = "2021-03-10"


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def consolidated_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """All ideas with the summary that they went into, and the summaries."""
    ideas, made = lifecycle.consolidated(*_t(spark, sf, "ideas", "spans"), F.lit(NOW))
    none = F.lit(None).cast("bigint")
    return ideas.select("id", "consolidated_into", none.alias("sources")).unionByName(made.select("id", none.alias("consolidated_into"), "sources"))


def delete_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Ideas left after the topics without a project went, with their ideas."""
    spans, ideas, topics = _t(spark, sf, "spans", "ideas", "topics")
    return lifecycle.delete_topics(spans, ideas, topics, topics.where("project_id IS NULL").select("id"), with_ideas=True)[1].select("id")


def orphaned_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of the spans after the topics without a project went."""
    spans, ideas, topics = _t(spark, sf, "spans", "ideas", "topics")
    left = lifecycle.delete_topics(spans, ideas, topics, topics.where("project_id IS NULL").select("id"))[0]
    return left.groupBy("topic_id").agg(F.count("*").alias("n"))


def prune_old(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.prune_old(*_t(spark, sf, "ideas", "relations"), F.lit(NOW), 14)[1].select("id")


def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of the ideas after the spans of the same session and name became one."""
    spans, ideas = _t(spark, sf, "spans", "ideas")
    return lifecycle.merge_spans(spans, ideas, lifecycle.same_spans(spans))[1].select("id", "span_id")


def answered_questions(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.answered(*_t(spark, sf, "ideas", "relations")).where("intent = 'question'").select("id", "answered")


def activate_related(spark: SparkSession, sf: str) -> DataFrame:
    """Activation, by session, of the ideas that its ideas relate to."""
    ideas, relations = _t(spark, sf, "ideas", "relations")
    mentions = relations.join(ideas.select(F.col("id").alias("from_id"), "session"), "from_id").select("session", F.col("to_id").alias("idea_id"))
    return lifecycle.fold_activation(mentions)


def access_track(spark: SparkSession, sf: str) -> DataFrame:
    """What showing the neighbours of every 50th idea does to the ideas shown."""
    return lifecycle.access_deltas(knn_ideas(spark, sf), table(spark, sf, "ideas"))


def decayed_memory(spark: SparkSession, sf: str) -> DataFrame:
    kept = lifecycle.decay(lifecycle.working_memory(table(spark, sf, "ideas"), F.lit(NOW), 0.9), 0.5, 0.2)
    return kept.select("session", "idea_id", F.round("activation", 6).alias("activation"))


def upsert_records(spark: SparkSession, sf: str) -> DataFrame:
    """Which record stands at each place in a file after the later arrivals went over the earlier ones."""
    rows = table(spark, sf, "synthetic_conversation").select("rec_id", "source_file", "line_num", "arrived_at")
    late = F.coalesce(F.col("arrived_at").cast("timestamp") >= LATER, F.lit(False))
    return records.upsert(rows.where(~late), rows.where(late), ["source_file", "line_num"], ["rec_id"]).select("rec_id")


def folder_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session name of each folder that holds transcripts, as of a working directory."""
    folders = table(spark, sf, "synthetic_conversation").select(F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("folder")).where("folder IS NOT NULL").distinct()
    return folders.select("folder", records.folder_to_session(F.col("folder")).alias("session"))


QUERIES = {
    f.__name__: f
    for f in (consolidated_ideas, delete_topics, orphaned_spans, prune_old, merge_spans, answered_questions, activate_related, access_track, decayed_memory, upsert_records, folder_sessions)
}

SQL = {
    "consolidated_ideas": f"""WITH {SPANS}, {TOPICAL}, {_CONS}, made AS (SELECT topic_id, n, (SELECT max(id) FROM ideas) + row_number() OVER (ORDER BY topic_id) AS id FROM cons),
      gone AS (SELECT ti.id, made.id AS consolidated_into FROM ti JOIN made ON made.topic_id = ti.topic_id WHERE {_OLD} AND {_PRESERVE})
      SELECT i.id, gone.consolidated_into, CAST(NULL AS BIGINT) AS sources FROM ideas i LEFT JOIN gone ON gone.id = i.id UNION ALL SELECT id, NULL, n FROM made""",
    "delete_topics": f"WITH {SPANS} SELECT id FROM ideas WHERE span_id IS NULL OR span_id NOT IN (SELECT sp.id FROM sp JOIN topics t ON t.id = sp.topic_id WHERE t.project_id IS NULL)",
    "orphaned_spans": "SELECT CASE WHEN t.id IS NULL THEN s.topic_id END AS topic_id, count(*) AS n FROM spans s LEFT JOIN (SELECT id FROM topics WHERE project_id IS NULL) t ON t.id = s.topic_id GROUP BY 1",
    "prune_old": f"WITH old AS (SELECT id FROM ideas WHERE floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us({SEEN})) / 86400000000) > 14) SELECT id FROM relations WHERE from_id NOT IN (SELECT id FROM old) AND to_id NOT IN (SELECT id FROM old)",
    "merge_spans": f"WITH {SPANS}, k AS (SELECT id, min(id) OVER (PARTITION BY session, trim(lower(name))) AS target FROM sp WHERE session IS NOT NULL AND length(trim(lower(name))) > 0) SELECT i.id, coalesce(k.target, i.span_id) AS span_id FROM ideas i LEFT JOIN k ON k.id = i.span_id",
    "activate_related": "SELECT session, to_id AS idea_id, least(1.0::DOUBLE, 1.0::DOUBLE + 0.5::DOUBLE * (count(*) - 1)) AS activation, count(*) AS mentions FROM relations r JOIN ideas i ON i.id = r.from_id GROUP BY 1, 2",
    "access_track": f"WITH {_ROWS}, {_KNN10}, n AS (SELECT id, count(*) AS n FROM hits GROUP BY 1) SELECT i.id, coalesce(access_count, 0) + n AS access_count, round(least(1.0::DOUBLE, 0.2::DOUBLE * n), 6) AS activation FROM ideas i JOIN n ON n.id = i.id",
    "decayed_memory": f"WITH {_WM} SELECT session, idea_id, round(activation * 0.5, 6) AS activation FROM wm WHERE activation >= 0.01 AND activation * 0.5 >= 0.2",
    "upsert_records": f"SELECT rec_id FROM synthetic_conversation QUALIFY source_file IS NULL OR line_num IS NULL OR row_number() OVER (PARTITION BY source_file, line_num ORDER BY coalesce(arrived_at >= TIMESTAMP '{LATER}', false) DESC, rec_id DESC) = 1",
    "folder_sessions": r"SELECT DISTINCT regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS folder, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(source_file, '^(.*)/[^/]*$', 1), '[/.]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '') AS session FROM synthetic_conversation WHERE source_file IS NOT NULL",
    "answered_questions": f"SELECT id, CASE WHEN id IN (SELECT to_id FROM relations WHERE relation_type = 'answers' AND from_id IN (SELECT id FROM ideas WHERE {VISIBLE})) THEN true ELSE answered END AS answered FROM ideas WHERE intent = 'question'",
}
