"""Queries on what surrounds spans and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, context, nearest
from ..session import table
from .shared import CENTROIDS, SEEN, SPANS, VECTORS, VISIBLE
from .structure import _CHAINS


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def ancestor_context(spark: SparkSession, sf: str) -> DataFrame:
    return context.ancestor_context(table(spark, sf, "spans"))


def span_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return context.span_summaries(*_t(spark, sf, "spans", "ideas"))


def span_texts(spark: SparkSession, sf: str) -> DataFrame:
    return context.span_texts(*_t(spark, sf, "spans", "ideas"))


def knn_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans nearest to each topic, by the mean vectors of their ideas."""
    ideas, spans = _t(spark, sf, "ideas", "spans")
    topics = clusters.centroids(clusters.topic_ideas(ideas, spans), "topic_id").select(F.col("topic_id").alias("id"), "v")
    return nearest.knn(topics, context.span_vectors(ideas), 5, with_self=True).withColumn("score", F.round("score", 6))


def related_topics_by_span(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with a span near to each topic's mean; related_topics compares means alone, as its SQL states."""
    return context.related_topics(*_t(spark, sf, "ideas", "spans")).withColumn("score", F.round("score", 6))


def topic_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return context.topic_expansion(*_t(spark, sf, "ideas", "spans")).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (ancestor_context, span_summaries, span_texts, knn_spans, related_topics_by_span, topic_expansion)}

_SPAN_CENTRES = """sm AS (SELECT i.span_id, vec.v FROM vec JOIN ideas i ON i.id = vec.id WHERE NOT coalesce(i.forgotten, false) AND i.span_id IS NOT NULL), sq AS (SELECT span_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM sm),
sr AS (SELECT span_id, list(x ORDER BY p) AS v FROM (SELECT span_id, p, round(avg(x), 9) AS x FROM sq GROUP BY 1, 2) GROUP BY 1)"""

SQL = {
    "ancestor_context": _CHAINS.replace("found AS (", f"{SPANS}, found AS (", 1)
    + """, c AS (SELECT id, unnest(list_reverse(chain)) AS ancestor_id, generate_subscripts(chain, 1) - 1 AS place FROM found WHERE NOT looped)
      SELECT c.id, CAST(place AS INTEGER) AS place, ancestor_id, sp.name FROM c JOIN sp ON sp.id = ancestor_id""",
    "span_summaries": f"""WITH {SPANS}, f AS (SELECT span_id, content FROM ideas WHERE length(content) > 30 AND span_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY {SEEN}, id) = 1)
      SELECT sp.id, coalesce(regexp_replace(content, '([.!?])\\s(.|\\n)*$', '\\1')[:200], 'Brief discussion') AS summary FROM (SELECT id FROM sp) sp LEFT JOIN (SELECT span_id, CASE WHEN regexp_matches(content, '[.!?]\\s') THEN regexp_extract(content, '^((?:.|\\n)*?[.!?])\\s', 1) ELSE content END AS content FROM f) f ON f.span_id = sp.id""",
    "span_texts": f"""WITH {SPANS}, o AS (SELECT span_id, id, {SEEN} AS t, content[:200] AS c, row_number() OVER (PARTITION BY span_id ORDER BY {SEEN}, id) AS a, row_number() OVER (PARTITION BY span_id ORDER BY {SEEN} DESC, id DESC) AS z FROM ideas WHERE {VISIBLE} AND span_id IS NOT NULL),
      k AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY t, id) AS n FROM o WHERE a <= 3 OR z <= 3), p AS (SELECT span_id, string_agg(c, '; ' ORDER BY t, id) AS points FROM k WHERE n <= 5 GROUP BY 1)
      SELECT sp.id, concat_ws(' | ', name, summary, 'Key points: ' || points)[:2000] AS text FROM sp LEFT JOIN p ON p.span_id = sp.id""",
    "knn_spans": f"""WITH {VECTORS}, {CENTROIDS}, {_SPAN_CENTRES}
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank, id, round(s, 6) AS score FROM (SELECT topic_id AS query_id, span_id AS id, round(list_cosine_similarity(centres.v, sr.v), 9) AS s FROM centres, sr) QUALIFY rank <= 5""",
    "related_topics_by_span": f"""WITH {VECTORS}, {CENTROIDS}, {_SPAN_CENTRES}, near AS (SELECT centres.topic_id AS query_id, sp.topic_id AS id, max(round(list_cosine_similarity(centres.v, sr.v), 9)) AS s FROM centres, sr JOIN sp ON sp.id = sr.span_id WHERE sp.topic_id <> centres.topic_id GROUP BY 1, 2)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank, id, round(s, 6) AS score FROM near WHERE s >= 0.8 QUALIFY rank <= 5""",
    "topic_expansion": f"""WITH {VECTORS}, {CENTROIDS}, l AS (SELECT a.topic_id AS query_id, b.topic_id, a.v AS q FROM centres a JOIN centres b ON a.topic_id <> b.topic_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.8 QUALIFY row_number() OVER (PARTITION BY a.topic_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.topic_id) <= 5)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank, id, topic_id, round(s, 6) AS score FROM (SELECT query_id, m.id, m.topic_id, round(list_cosine_similarity(m.v, q), 9) AS s FROM members m JOIN l ON l.topic_id = m.topic_id) QUALIFY rank <= 10""",
}
