"""Searches that analyse a question or narrow what is searched, and reports composed of other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import questions
from ..operators import analytics, batching, clusters, context, graph, lifecycle, memory, nearest, records, search
from ..session import table
from .connections import _MESSAGES
from .insights import NOW
from .retrieval import _COHERENCE, _COS, _TOPIC_TEXTS, _bm25, _knn, _six, _topic_texts, _topic_vectors
from .shared import CENTROIDS, PERIODS, SEEN, SPANS, TOPICAL, VECTORS, VISIBLE
from .surroundings import _SPAN_CENTRES

DIM, K = 64, 10
KEPT = ("decision", "solution")


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def _asked(spark, sf) -> DataFrame:
    """A question of each kind about the topics."""
    name, kind = F.col("canonical_name"), F.pmod("id", F.lit(4))
    text = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("Decisions about "), name)).when(kind == 2, F.concat(name, F.lit(" relates to caching")))
    return table(spark, sf, "topics").select(F.col("id").alias("query_id"), text.otherwise(F.concat(F.lit("The "), name, F.lit(" and write path recently"))).alias("text"))


def _analyzed(spark, sf) -> DataFrame:
    return questions.analyzed(_asked(spark, sf), F.lit(NOW).cast("timestamp"))


def analyze_queries(spark: SparkSession, sf: str) -> DataFrame:
    a = _analyzed(spark, sf)
    return a.select("query_id", "kind", F.array_join("parts", "|").alias("parts"), "intent", F.unix_micros("since").alias("since_us"), F.array_join("technologies", "|").alias("technologies"))


def search_auto(spark: SparkSession, sf: str) -> DataFrame:
    rows = memory.visible(table(spark, sf, "ideas")).select("id", F.col("content").alias("text"), "intent", memory.when_said().alias("at"))
    return search.search_auto(_analyzed(spark, sf), rows, K)


def fts_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of the user that hold words of each topic's name."""
    rows = records.messages(table(spark, sf, "synthetic_conversation")).where("role = 'user'").select(F.col("rec_id").alias("id"), F.col("content").alias("text"))
    return search.bm25(_topic_texts(spark, sf), rows, K).withColumn("score", F.round("score", 6))


def _kept(spark, sf) -> DataFrame:
    ideas = memory.visible(table(spark, sf, "ideas"))
    return ideas.where(F.col("intent").isin(*KEPT) & (memory.when_said() >= "2021-03-04"))


def knn_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours among the decisions and solutions since a day: filtered before the search."""
    rows = nearest.usable(memory.visible(table(spark, sf, "ideas")), "id", "embedding", DIM)
    return nearest.knn(rows.where("id % 50 = 0"), nearest.usable(_kept(spark, sf), "id", "embedding", DIM), K, DIM).withColumn("score", F.round("score", 6))


def rrf_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and keyword list of each topic, both among the decisions and solutions since a day, fused."""
    kept = _kept(spark, sf)
    vector = nearest.knn(_topic_vectors(spark, sf), nearest.usable(kept, "id", "embedding", DIM), 2 * K, DIM, with_self=True)
    keyword = search.bm25(_topic_texts(spark, sf), kept.select("id", F.col("content").alias("text")), 2 * K)
    return search.rrf([vector, keyword], K).withColumn("score", F.round("score", 6))


def after_session(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search of the topics among the ideas said after the first session, by name."""
    ideas = table(spark, sf, "ideas")
    first = ideas.agg(F.min("session")).first()[0]
    rows = analytics.after_session(ideas, F.lit(first)).where(~F.coalesce("forgotten", F.lit(False)))
    return search.bm25(_topic_texts(spark, sf), rows.select("id", F.col("content").alias("text")), K).withColumn("score", F.round("score", 6))


def related_via_links(spark: SparkSession, sf: str) -> DataFrame:
    ideas, spans, topics = _t(spark, sf, "ideas", "spans", "topics")
    centres = clusters.centroids(clusters.topic_ideas(ideas, spans), "topic_id").select(F.col("topic_id").alias("id"), "v")
    return graph.best_links(graph.topic_links(centres, lifecycle.topic_times(topics, spans), 0.8))


def idea_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    ideas, relations = _t(spark, sf, "ideas", "relations")
    return graph.neighbours(graph.among(relations, memory.visible(ideas)))


def trace_visible(spark: SparkSession, sf: str) -> DataFrame:
    """What each visible idea leads to in three hops along visible ideas, at most ten a hop."""
    ideas, relations = _t(spark, sf, "ideas", "relations")
    seen = memory.visible(ideas)
    return graph.walk(seen, graph.among(relations, seen), 3, "out", 10)


def span_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return context.span_similarity(table(spark, sf, "ideas")).select("id", "span_id", F.round("similarity", 6).alias("similarity"))


def span_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Shifts in each session, by the similarity of each idea to its span."""
    return batching.semantic_shift(context.span_similarity(table(spark, sf, "ideas")).where("session IS NOT NULL").select("session", "at", "id", "similarity"))


def topic_reflection(spark: SparkSession, sf: str) -> DataFrame:
    return context.topic_reflection(*_t(spark, sf, "ideas", "spans"))


def span_texts_confident(spark: SparkSession, sf: str) -> DataFrame:
    return context.span_texts_confident(*_t(spark, sf, "spans", "ideas"))


def cluster_report(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster_report(clusters.topic_ideas(*_t(spark, sf, "ideas", "spans")))


def topic_key_ideas(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.topic_key_ideas(*_t(spark, sf, "ideas", "spans"), "week")


def activity_recent(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.activity(analytics.recent(table(spark, sf, "ideas"), NOW, 14), "day")


def project_timeline_recent(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.project_timeline(*_t(spark, sf, "ideas", "spans"), 14, NOW)


def top_accessed(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_accessed(table(spark, sf, "ideas"))


def messages_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return records.messages(table(spark, sf, "synthetic_conversation")).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


def latest_spans(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.latest_spans(table(spark, sf, "spans"))


QUERIES = {
    f.__name__: f
    for f in (
        analyze_queries, search_auto, fts_messages, knn_kept, rrf_kept, after_session, related_via_links, idea_neighbours, trace_visible, span_similarity, span_shift,
        topic_reflection, span_texts_confident, cluster_report, topic_key_ideas, activity_recent, project_timeline_recent, top_accessed, messages_by_role, latest_spans,
    )
}

_KEPT = f"{VISIBLE} AND intent IN ('decision', 'solution') AND {SEEN} >= TIMESTAMP '2021-03-04'"
_KEPT_ROWS = f"kept AS (SELECT vec.* FROM vec SEMI JOIN (SELECT id FROM ideas WHERE {_KEPT}) USING (id))"
_QUERIES = f"queries AS (SELECT vec.id AS query_id, v AS qv FROM vec SEMI JOIN (SELECT id FROM ideas WHERE {VISIBLE}) USING (id) WHERE id % 50 = 0)"
_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b{i}s?\\b') THEN '{i}'" for i in questions.INTENT_WORDS) + " END"
_TECHS = "array_to_string(list_filter([{}], lambda t: contains(lower(text), t)), '|')".format(", ".join(f"'{t}'" for t in questions.QUERY_TECHNOLOGIES))
#: The questions, whose parts are known from how they are made.
_ASKED = """asked AS (SELECT id AS query_id, id % 4 AS k, canonical_name AS c,
  CASE id % 4 WHEN 0 THEN c WHEN 1 THEN 'Decisions about ' || c WHEN 2 THEN c || ' relates to caching' ELSE 'The ' || c || ' and write path recently' END AS text FROM topics),
kinds AS (SELECT *, ['simple', 'intent_scoped', 'relation', 'conjunction'][k + 1] AS kind,
  CASE k WHEN 0 THEN [c] WHEN 1 THEN [c] WHEN 2 THEN [c, 'caching'] ELSE ['the ' || c, 'write path recently'] END AS parts,
  CASE WHEN k = 1 THEN 'decision' ELSE """ + _NAMED + f""" END AS intent, CASE WHEN k = 3 THEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY END AS since FROM asked)"""
_AUTO = _bm25("kl", "SELECT query_id * 2 + p AS query_id, parts[p + 1] AS text FROM kinds, (SELECT unnest([0, 1]) AS p) WHERE p < len(parts)", f"SELECT id, content AS text FROM ideas WHERE {VISIBLE}", 20).replace(
    "FROM kl_s  QUALIFY", f"FROM (SELECT s.* FROM kl_s s JOIN kinds q ON q.query_id = s.query_id // 2 JOIN ideas i ON i.id = s.id WHERE (q.intent IS NULL OR i.intent = q.intent) AND (q.since IS NULL OR coalesce(i.message_time, i.created_at) BETWEEN q.since AND TIMESTAMP '{NOW}')) QUALIFY"
)
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY {}) AS INTEGER) AS rank"
_DIST = "topic_distance AS (SELECT m.id, m.topic_id, round(1 - list_cosine_similarity(m.v, c.v), 9) AS d FROM members m JOIN centres c USING (topic_id))"
_OWN = f"""WITH {VECTORS}, {_SPAN_CENTRES}, ss AS (SELECT i.id, i.session, i.span_id, {SEEN} AS said, round(list_cosine_similarity(vec.v, sr.v), 9) AS s0 FROM vec JOIN ideas i ON i.id = vec.id JOIN sr ON sr.span_id = i.span_id WHERE NOT coalesce(i.forgotten, false))"""


def _trace() -> str:
    out = f"""WITH vi AS (SELECT id FROM ideas WHERE {VISIBLE}), st AS (SELECT DISTINCT from_id AS id, to_id AS nx FROM relations WHERE from_id <> to_id AND from_id IN (SELECT id FROM vi) AND to_id IN (SELECT id FROM vi)),
f0 AS (SELECT DISTINCT id AS seed, id, 0 AS hop, CAST(NULL AS BIGINT) AS parent FROM vi), w0 AS (SELECT * FROM f0)"""
    for h in range(1, 4):
        out += f""", f{h} AS (SELECT seed, nx AS id, {h} AS hop, min(id) AS parent FROM (SELECT f.seed, st.nx, f.id FROM f{h - 1} f JOIN st ON st.id = f.id ANTI JOIN w{h - 1} w ON w.seed = f.seed AND w.id = st.nx) GROUP BY seed, nx QUALIFY row_number() OVER (PARTITION BY seed ORDER BY nx) <= 10), w{h} AS (SELECT * FROM w{h - 1} UNION ALL SELECT * FROM f{h})"""
    return out + " SELECT * FROM w3"


SQL = {
    "analyze_queries": f"WITH {_ASKED} SELECT query_id, kind, array_to_string(parts, '|') AS parts, intent, epoch_us(since) AS since_us, {_TECHS} AS technologies FROM kinds",
    "search_auto": f"""WITH {_ASKED}, {_AUTO}, l AS (SELECT kl.query_id // 2 AS query_id, kl.query_id % 2 AS part, rank, id, kind FROM kl JOIN kinds ON kinds.query_id = kl.query_id // 2),
      c AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)) * CASE WHEN count(*) > 1 THEN 1.5::DOUBLE ELSE 1 END, 9) AS s FROM l WHERE kind = 'conjunction' GROUP BY 1, 2), r AS (SELECT query_id, id, count(*) AS n, min((part, rank)) AS f FROM l WHERE kind = 'relation' GROUP BY 1, 2)
      SELECT query_id, rank, id, kind FROM l WHERE kind IN ('simple', 'intent_scoped') AND rank <= 10
      UNION ALL SELECT query_id, {_RANK.format('s DESC, id')}, id, 'conjunction' FROM c QUALIFY rank <= 10 UNION ALL SELECT query_id, {_RANK.format('n DESC, f, id')}, id, 'relation' FROM r QUALIFY rank <= 10""",
    "fts_messages": _MESSAGES + ", " + _bm25("kl", _TOPIC_TEXTS, "SELECT rec_id AS id, content AS text FROM msg WHERE role = 'user'", 10) + " SELECT query_id, rank, id, round(score, 6) AS score FROM kl",
    "knn_kept": _six(f"{VECTORS}, {_KEPT_ROWS}, {_QUERIES}", _knn(_COS, "s DESC", 10, rows="kept")),
    "rrf_kept": f"""WITH {VECTORS}, {CENTROIDS}, {_KEPT_ROWS}, vl AS (SELECT topic_id AS query_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(list_cosine_similarity(centres.v, kept.v), 9) DESC, id) AS INTEGER) AS rank, id FROM centres, kept QUALIFY rank <= 20),
      {_bm25('kl', _TOPIC_TEXTS, f'SELECT id, content AS text FROM ideas WHERE {_KEPT}', 20)}, every AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS share FROM vl UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM kl),
      fused AS (SELECT query_id, id, round(sum(share), 9) AS score, count(*) AS lists FROM every GROUP BY 1, 2) SELECT query_id, {_RANK.format('score DESC, id')}, id, round(score, 6) AS score, lists FROM fused QUALIFY rank <= 10""",
    "after_session": _six(_bm25("kl", _TOPIC_TEXTS, f"SELECT id, content AS text FROM ideas WHERE {VISIBLE} AND {SEEN} > (SELECT max({SEEN}) FROM ideas WHERE session = (SELECT min(session) FROM ideas))", 10), "FROM kl"),
    "related_via_links": f"""WITH {VECTORS}, {CENTROIDS} SELECT a.topic_id, CAST(row_number() OVER (PARTITION BY a.topic_id ORDER BY round(round(list_cosine_similarity(a.v, b.v), 9), 6) DESC, b.topic_id) AS INTEGER) AS rank, b.topic_id AS related_topic_id, round(round(list_cosine_similarity(a.v, b.v), 9), 6) AS similarity
      FROM centres a JOIN centres b ON a.topic_id <> b.topic_id AND a.topic_id IN (SELECT id FROM topics) AND b.topic_id IN (SELECT id FROM topics) WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.8 QUALIFY rank <= 3""",
    "idea_neighbours": f"""WITH vi AS (SELECT id FROM ideas WHERE {VISIBLE}), r AS (SELECT * FROM relations WHERE from_id IN (SELECT id FROM vi) AND to_id IN (SELECT id FROM vi)),
      b AS (SELECT from_id AS id, 'out' AS direction, relation_type, to_id AS other FROM r UNION SELECT to_id, 'in', relation_type, from_id FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY id, direction, relation_type ORDER BY other) AS k FROM b)
      SELECT id, direction, relation_type, count(*) AS n, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FILTER (k <= 5) AS others FROM n GROUP BY 1, 2, 3""",
    "trace_visible": _trace(),
    "span_similarity": _OWN + " SELECT id, span_id, round(s0, 6) AS similarity FROM ss",
    "span_shift": _OWN
    + """, h AS (SELECT *, lag(s0) OVER k AS s1, lag(s0, 2) OVER k AS s2 FROM ss WHERE session IS NOT NULL WINDOW k AS (PARTITION BY session ORDER BY said NULLS FIRST, id))
      SELECT session, id, s0 < 0.55::DOUBLE - 0.15::DOUBLE OR (s0 < 0.55 AND (coalesce(s1 < 0.55, false) OR coalesce(s2 < 0.55, false))) AS shift FROM h""",
    "topic_reflection": f"""WITH {SPANS}, {TOPICAL}, o AS (SELECT topic_id, '- [' || coalesce(intent, 'context') || '] ' || coalesce(content, '')[:150] AS line, row_number() OVER (PARTITION BY topic_id ORDER BY {SEEN} NULLS FIRST, id) AS n FROM ti WHERE topic_id IS NOT NULL)
      SELECT topic_id, string_agg(line, chr(10) ORDER BY n) AS text FROM o WHERE n <= 30 GROUP BY 1""",
    "span_texts_confident": f"""WITH {SPANS}, o AS (SELECT span_id, coalesce(content, '') AS c, row_number() OVER (PARTITION BY span_id ORDER BY confidence DESC NULLS LAST, id) AS n FROM ideas WHERE {VISIBLE} AND span_id IS NOT NULL), p AS (SELECT span_id, string_agg(c, chr(10) ORDER BY n) AS points FROM o WHERE n <= 10 GROUP BY 1)
      SELECT sp.id, concat_ws(chr(10), name, points)[:2000] AS text FROM sp LEFT JOIN p ON p.span_id = sp.id""",
    "cluster_report": _COHERENCE
    + """, o AS (SELECT m.id, round(1 - round(list_cosine_similarity(m.v, c.v), 9), 9) AS d FROM members m JOIN centres c ON c.topic_id <> m.topic_id QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY round(list_cosine_similarity(m.v, c.v), 9) DESC, c.topic_id) = 1),
      a AS (SELECT t.topic_id, count(*) AS misplaced FROM topic_distance t JOIN o ON o.id = t.id WHERE o.d < 0.8::DOUBLE * t.d GROUP BY 1),
      p AS (SELECT a.topic_id, count(*) AS partners FROM centres a JOIN centres b ON a.topic_id <> b.topic_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.85 GROUP BY 1)
      SELECT co.topic_id, size, score, coalesce(misplaced, 0) AS misplaced, coalesce(partners, 0) AS partners, size >= 5 AND score < 0.7 AS may_split FROM co LEFT JOIN a ON a.topic_id = co.topic_id LEFT JOIN p ON p.topic_id = co.topic_id""",
    "topic_key_ideas": f"""WITH {SPANS}, {TOPICAL}, k AS (SELECT *, {PERIODS['week'](SEEN)} AS period FROM ti WHERE topic_id IS NOT NULL AND intent IN ('decision', 'conclusion', 'solution'))
      SELECT topic_id, period, CAST(row_number() OVER (PARTITION BY topic_id, period ORDER BY CASE intent WHEN 'decision' THEN 1 WHEN 'conclusion' THEN 2 ELSE 3 END, confidence DESC NULLS LAST, id) AS INTEGER) AS place, id AS idea_id, intent, content[:100] AS content FROM k QUALIFY place <= 3""",
    "activity_recent": f"""SELECT {PERIODS['day'](SEEN)} AS period, count(*) AS total, count(*) FILTER (intent = 'decision') AS decisions, count(*) FILTER (intent = 'question') AS questions, count(*) FILTER (intent = 'conclusion') AS conclusions, count(DISTINCT session) AS sessions
      FROM ideas WHERE {VISIBLE} AND {SEEN} >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY 1""",
    "project_timeline_recent": f"WITH {SPANS}, {TOPICAL} SELECT session, strftime({SEEN}, '%Y-%m-%d') AS date, count(*) AS ideas, count(*) FILTER (intent = 'decision') AS decisions, count(DISTINCT topic_id) AS topics FROM ti WHERE {SEEN} >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY 1, 2",
    "top_accessed": "SELECT id, access_count FROM ideas WHERE access_count > 0 ORDER BY access_count DESC, id LIMIT 5",
    "messages_by_role": _MESSAGES + " SELECT role, count(*) AS n, count(DISTINCT session) AS sessions FROM msg GROUP BY 1",
    "latest_spans": f"WITH {SPANS} SELECT session, id AS span_id FROM sp WHERE session IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY start_line DESC NULLS LAST, id DESC) = 1",
}
