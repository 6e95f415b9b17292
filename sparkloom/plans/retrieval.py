"""Vector, keyword and fused searches. Queries are stated sets: every 50th idea, or all topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, memory, nearest, search
from ..session import table
from .shared import CENTROIDS, SPANS, VECTORS, VISIBLE, WORDS

DIM, K = 64, 10


def _ideas(spark, sf) -> DataFrame:
    return table(spark, sf, "ideas")


def _rows(spark, sf) -> DataFrame:
    return nearest.usable(memory.visible(_ideas(spark, sf)), "id", "embedding", DIM)


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _centres(spark, sf) -> DataFrame:
    return clusters.centroids(clusters.topic_ideas(_ideas(spark, sf), table(spark, sf, "spans"), DIM), "topic_id", DIM)


def _topic_vectors(spark, sf) -> DataFrame:
    return _centres(spark, sf).select(F.col("topic_id").alias("id"), "v")


def _topic_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "topics").select(F.col("id").alias("query_id"), F.col("canonical_name").alias("text"))


def _idea_texts(spark, sf) -> DataFrame:
    return memory.visible(_ideas(spark, sf)).select("id", F.col("content").alias("text"))


def knn_ideas(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return _scored(nearest.knn(rows.where("id % 50 = 0"), rows, K, DIM))


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return _scored(nearest.knn(rows.where("id % 50 = 0"), rows, K, DIM, "l2"))


def knn_temporal(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours among the ideas of three days: filtered before the search, so none is lost to a cut."""
    ideas = memory.visible(_ideas(spark, sf))
    then = ideas.where(memory.when_said().between("2021-03-04", "2021-03-07"))
    return _scored(nearest.knn(_rows(spark, sf).where("id % 50 = 0"), nearest.usable(then, "id", "embedding", DIM), K, DIM))


def similar_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours without those already related, however many these are."""
    rows, relations = _rows(spark, sf), table(spark, sf, "relations")
    pairs = relations.select(F.col("from_id").alias("query_id"), F.col("to_id").alias("id")).unionByName(relations.select(F.col("to_id").alias("query_id"), F.col("from_id").alias("id")))
    return _scored(nearest.knn_apart(rows.where("id % 50 = 0"), rows, pairs, K, DIM))


def topic_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = _centres(spark, sf)
    return c.select("topic_id", "size", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def topic_coherence(spark: SparkSession, sf: str) -> DataFrame:
    rows = clusters.topic_ideas(_ideas(spark, sf), table(spark, sf, "spans"), DIM)
    return clusters.coherence(rows, clusters.centroids(rows, "topic_id", DIM), "topic_id")


def split_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.split_candidates(topic_coherence(spark, sf), 5, 0.7).select("topic_id", "size", "score")


def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.merge_candidates(_centres(spark, sf), "topic_id", 0.85, DIM)


def misplaced_ideas(spark: SparkSession, sf: str) -> DataFrame:
    rows = clusters.topic_ideas(_ideas(spark, sf), table(spark, sf, "spans"), DIM)
    return clusters.misplaced(rows, clusters.centroids(rows, "topic_id", DIM), DIM)


def related_topics(spark: SparkSession, sf: str) -> DataFrame:
    points = _topic_vectors(spark, sf)
    return _scored(nearest.knn(points, points, 5, DIM))


def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.kmeans(_rows(spark, sf))


def bm25_ideas(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(search.bm25(_topic_texts(spark, sf), _idea_texts(spark, sf), K))


def bm25_all_words(spark: SparkSession, sf: str) -> DataFrame:
    texts = _topic_texts(spark, sf).withColumn("text", F.regexp_replace("text", " [0-9]+$", ""))
    return _scored(search.bm25(texts, _idea_texts(spark, sf), K, "and"))


def fts_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(search.bm25(_topic_texts(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), K))


def fts_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = memory.spans(table(spark, sf, "spans")).select("id", F.concat_ws(" ", "name", "summary").alias("text"))
    return _scored(search.bm25(_topic_texts(spark, sf), rows, K))


def _both(spark, sf):
    vector = nearest.knn(_topic_vectors(spark, sf), _rows(spark, sf), 2 * K, DIM, with_self=True)
    return vector, search.bm25(_topic_texts(spark, sf), _idea_texts(spark, sf), 2 * K)


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(search.rrf([*_both(spark, sf)], K))


def rrf_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(search.rrf([*_both(spark, sf)], K, 1.5))


def both_first(spark: SparkSession, sf: str) -> DataFrame:
    return search.both_first(*_both(spark, sf), K)


def research(spark: SparkSession, sf: str) -> DataFrame:
    return search.research(*_both(spark, sf), 2 * K)


def multi_search(spark: SparkSession, sf: str) -> DataFrame:
    vector, keyword = _both(spark, sf)
    lists = [vector.withColumn("distance", F.round(1 - F.col("score"), 6)), keyword.withColumn("distance", F.lit(None).cast("double"))]
    return search.multi_search([x.select("query_id", "id", "distance") for x in lists], 15)


def activation_rerank(spark: SparkSession, sf: str) -> DataFrame:
    act = _ideas(spark, sf).select("id", F.least(F.lit(1.0), F.col("access_count") / 50).alias("activation"))
    return _scored(search.activation_rerank(knn_ideas(spark, sf), act))


def boost_active(spark: SparkSession, sf: str) -> DataFrame:
    act = _ideas(spark, sf).select("id", F.least(F.lit(1.0), F.col("access_count") / 50).alias("activation"))
    hits = knn_ideas(spark, sf).select("query_id", "id", F.round(1 - F.col("score"), 6).alias("distance"))
    return search.boost_active(hits, act).withColumn("distance", F.round("distance", 6))


def enrich_relations(spark: SparkSession, sf: str) -> DataFrame:
    return search.enrich_relations(_ideas(spark, sf), table(spark, sf, "relations"))


def like_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.like_search(_ideas(spark, sf), "the cache", 100)


QUERIES = {
    f.__name__: f
    for f in (
        knn_ideas, knn_l2, knn_temporal, similar_ideas, topic_centroids, topic_coherence, split_candidates, merge_candidates, misplaced_ideas, related_topics, kmeans, bm25_ideas,
        bm25_all_words, fts_documents, fts_spans, rrf_hybrid, rrf_conjunction, both_first, research, multi_search, activation_rerank, boost_active, enrich_relations, like_search,
    )
}

_ROWS = f"{VECTORS}, rows_ AS (SELECT vec.* FROM vec SEMI JOIN (SELECT id FROM ideas WHERE {VISIBLE}) USING (id)), queries AS (SELECT id AS query_id, v AS qv FROM rows_ WHERE id % 50 = 0)"
_COS = "round(list_cosine_similarity(qv, v), 9)"


def _knn(score: str, order: str, k: int, where: str = "true", rows: str = "rows_") -> str:
    return f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS INTEGER) AS rank, id, s AS score FROM (SELECT query_id, id, {score} AS s FROM queries, {rows} WHERE query_id <> id AND {where}) QUALIFY rank <= {k}"


def _bm25(name: str, queries: str, rows: str, k: int, every: bool = False) -> str:
    """Tables of one keyword search: `name` has query_id, rank, id, score."""
    n = name
    return f"""{n}_q AS (SELECT DISTINCT query_id, unnest({WORDS.format('text')}) AS term FROM ({queries})),
{n}_b AS (SELECT id, {WORDS.format('text')} AS words FROM ({rows})), {n}_w AS (SELECT count(*) AS rows, avg(len(words)) AS mean FROM {n}_b),
{n}_p AS (SELECT id, len(words) AS size, unnest(words) AS term FROM {n}_b), {n}_t AS (SELECT id, size, term, count(*) AS tf FROM {n}_p SEMI JOIN {n}_q USING (term) GROUP BY ALL),
{n}_d AS (SELECT term, greatest(1e-6::DOUBLE, ln((any_value(rows) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE))) AS idf, any_value(mean) AS mean FROM {n}_t, {n}_w GROUP BY term),
{n}_s AS (SELECT query_id, id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 9) AS score, count(*) AS met FROM {n}_t JOIN {n}_q USING (term) JOIN {n}_d USING (term) GROUP BY query_id, id),
{n} AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM {n}_s {f'JOIN (SELECT query_id, count(*) AS wanted FROM {n}_q GROUP BY 1) USING (query_id) WHERE met = wanted' if every else ''} QUALIFY rank <= {k})"""


_TOPIC_TEXTS = "SELECT id AS query_id, canonical_name AS text FROM topics"
_IDEA_TEXTS = f"SELECT id, content AS text FROM ideas WHERE {VISIBLE}"
_KNN10 = f"hits AS ({_knn(_COS, 's DESC', 10)})"
_BOTH = f"""WITH {VECTORS}, {CENTROIDS}, rows_ AS (SELECT vec.* FROM vec SEMI JOIN (SELECT id FROM ideas WHERE {VISIBLE}) USING (id)),
vl AS (SELECT topic_id AS query_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(list_cosine_similarity(centres.v, rows_.v), 9) DESC, id) AS INTEGER) AS rank, id, round(list_cosine_similarity(centres.v, rows_.v), 9) AS score FROM centres, rows_ QUALIFY rank <= 20),
{_bm25('kl', _TOPIC_TEXTS, _IDEA_TEXTS, 20)}"""
_FUSED = """, every AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS share FROM vl UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM kl),
fused AS (SELECT query_id, id, round(sum(share) * CASE WHEN count(*) > 1 THEN {boost}::DOUBLE ELSE 1 END, 9) AS score, count(*) AS lists FROM every GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score, lists FROM fused QUALIFY rank <= 10"""


def _six(sql_with: str, select: str) -> str:
    return f"WITH {sql_with} SELECT query_id, rank, id, round(score, 6) AS score FROM ({select})"


_DIST = "topic_distance AS (SELECT m.id, m.topic_id, round(1 - list_cosine_similarity(m.v, c.v), 9) AS d, 1 - list_cosine_similarity(m.v, c.v) AS raw FROM members m JOIN centres c USING (topic_id))"
_COHERENCE = f"WITH {VECTORS}, {CENTROIDS}, {_DIST}, co AS (SELECT topic_id, count(*) AS size, round(avg(raw), 4) AS mean_distance, round(max(raw), 4) AS max_distance, round(1 - avg(raw), 3) AS score FROM topic_distance GROUP BY topic_id)"

SQL = {
    "knn_ideas": _six(_ROWS, _knn(_COS, "s DESC", 10)),
    "knn_l2": _six(_ROWS, _knn("round(list_distance(qv, v), 9)", "s", 10)),
    "knn_temporal": _six(_ROWS + f", then_ AS (SELECT rows_.* FROM rows_ SEMI JOIN (SELECT id FROM ideas WHERE coalesce(message_time, created_at) BETWEEN TIMESTAMP '2021-03-04' AND TIMESTAMP '2021-03-07') USING (id))", _knn(_COS, "s DESC", 10, rows="then_")),
    "similar_ideas": _six(
        _ROWS + ", pairs AS (SELECT from_id AS a, to_id AS b FROM relations UNION SELECT to_id, from_id FROM relations)",
        _knn(_COS, "s DESC", 10, "NOT EXISTS (SELECT 1 FROM pairs WHERE a = query_id AND b = id)"),
    ),
    "topic_centroids": f"WITH {VECTORS}, {CENTROIDS}, n AS (SELECT topic_id, count(*) AS size FROM members GROUP BY 1) SELECT topic_id, size, round(v[1], 6) AS first, round(list_sum(v), 5) AS total FROM centres JOIN n USING (topic_id)",
    "topic_coherence": _COHERENCE + " SELECT * FROM co",
    "split_candidates": _COHERENCE + " SELECT topic_id, size, score FROM co WHERE size >= 5 AND score < 0.7",
    "merge_candidates": f"WITH {VECTORS}, {CENTROIDS} SELECT a.topic_id AS a, b.topic_id AS b, round(round(list_cosine_similarity(a.v, b.v), 9), 6) AS similarity FROM centres a JOIN centres b ON a.topic_id < b.topic_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.85",
    "misplaced_ideas": f"""WITH {VECTORS}, {CENTROIDS}, {_DIST},
o AS (SELECT m.id, round(1 - round(list_cosine_similarity(m.v, c.v), 9), 9) AS d, c.topic_id AS better_id FROM members m JOIN centres c ON c.topic_id <> m.topic_id QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY round(list_cosine_similarity(m.v, c.v), 9) DESC, c.topic_id) = 1)
SELECT t.id, t.topic_id, better_id, round(t.d, 6) AS own, round(o.d, 6) AS other, round(100 * (t.d - o.d) / t.d, 1) AS improvement FROM topic_distance t JOIN o ON o.id = t.id WHERE o.d < 0.8::DOUBLE * t.d""",
    "related_topics": f"WITH {VECTORS}, {CENTROIDS}, queries AS (SELECT topic_id AS query_id, v AS qv FROM centres), rows_ AS (SELECT topic_id AS id, v FROM centres) SELECT query_id, rank, id, round(score, 6) AS score FROM ({_knn(_COS, 's DESC', 5)})",
    "bm25_ideas": _six(_bm25("kl", _TOPIC_TEXTS, _IDEA_TEXTS, 10), "FROM kl"),
    "bm25_all_words": _six(_bm25("kl", "SELECT id AS query_id, regexp_replace(canonical_name, ' [0-9]+$', '') AS text FROM topics", _IDEA_TEXTS, 10, True), "FROM kl"),
    "fts_documents": _six(_bm25("kl", _TOPIC_TEXTS, "SELECT doc_id AS id, text FROM documents", 10), "FROM kl"),
    "fts_spans": _six(f"{SPANS}, " + _bm25("kl", _TOPIC_TEXTS, "SELECT id, concat_ws(' ', name, summary) AS text FROM sp", 10), "FROM kl"),
    "rrf_hybrid": _BOTH + _FUSED.format(boost="1.0"),
    "rrf_conjunction": _BOTH + _FUSED.format(boost="1.5"),
    "both_first": _BOTH
    + """, r AS (SELECT query_id, id, 0 AS l, rank FROM vl UNION ALL SELECT query_id, id, 1, rank FROM kl), one AS (SELECT query_id, id, count(*) AS n, min((l, rank)) AS f FROM r GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f, id) AS INTEGER) AS rank, id FROM one QUALIFY rank <= 10""",
    "research": _BOTH
    + """, z AS (SELECT query_id, max(rank) AS size FROM vl GROUP BY 1),
j AS (SELECT coalesce(vl.query_id, kl.query_id) AS query_id, coalesce(vl.id, kl.id) AS id, vl.rank AS v, kl.rank AS h FROM vl FULL JOIN kl ON vl.query_id = kl.query_id AND vl.id = kl.id),
s AS (SELECT query_id, id, CAST(CASE WHEN v IS NOT NULL AND h IS NOT NULL THEN least(v, h) - 0.5 WHEN h IS NULL THEN v ELSE h + coalesce(size, 0) END AS DOUBLE) AS score, CASE WHEN v IS NOT NULL AND h IS NOT NULL THEN 'both' WHEN h IS NULL THEN 'vector' ELSE 'keyword' END AS found FROM j LEFT JOIN z USING (query_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INTEGER) AS rank, id, score, found FROM s QUALIFY rank <= 20""",
    "multi_search": _BOTH
    + """, every AS (SELECT query_id, id, 0 AS strategy, round(1 - score, 6) AS distance FROM vl UNION ALL SELECT query_id, id, 1, NULL FROM kl),
f AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY strategy) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(distance, 999), id) AS INTEGER) AS rank, id, strategy, distance FROM f QUALIFY rank <= 15""",
    "activation_rerank": f"""WITH {_ROWS}, {_KNN10}, s AS (SELECT query_id, hits.id, round(0.7::DOUBLE * (1 - (rank - 1) / count(*) OVER (PARTITION BY query_id)) + 0.3::DOUBLE * least(1.0::DOUBLE, access_count / 50), 9) AS score FROM hits JOIN ideas ON ideas.id = hits.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM s""",
    "boost_active": f"""WITH {_ROWS}, {_KNN10}, a AS (SELECT query_id, hits.id, round(1 - round(score, 6), 6) AS d, least(1.0::DOUBLE, access_count / 50) AS act FROM hits JOIN ideas ON ideas.id = hits.id),
s AS (SELECT query_id, id, round(CASE WHEN act > 0.1 THEN greatest(0.0::DOUBLE, d * (1 - 0.3::DOUBLE * act)) ELSE d END, 9) AS distance FROM a)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM s""",
    "enrich_relations": """WITH e AS (SELECT from_id AS id, to_id AS other_id, relation_type, 'out' AS direction, id AS relation_id FROM relations UNION ALL SELECT to_id, from_id, relation_type, 'in', id FROM relations)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY direction DESC, relation_id) AS INTEGER) AS place, other_id, relation_type, direction FROM e SEMI JOIN (SELECT id FROM ideas) q USING (id) QUALIFY place <= 3""",
    "like_search": "SELECT id FROM ideas WHERE contains(lower(content), 'the cache') ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 100",
}
