"""Searches fused from several others with all their strategies, topics cut into clusters, and what is stored or linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clusters, entities, graph, lifecycle, memory, nearest, records, search
from ..session import materialize, shared_dir, table
from .connections import _MESSAGES
from .insights import _any, _clean
from .retrieval import _IDEA_TEXTS, _bm25, _both, _idea_texts, _topic_texts, _topic_vectors
from .shared import CENTROIDS, SEEN, VECTORS, VISIBLE

DIM, K, MOST = 64, 10, 15
LATER = "2021-03-10"
#: The intents that have a search strategy of their own.
INTENTS = ("decision", "todo", "question", "problem", "solution")


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def _by_strategy(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Vector and fused list, query_id * 8 + s: of all visible ideas (s = 0) and of those of each intent."""
    ideas = memory.visible(table(spark, sf, "ideas"))
    points = _topic_vectors(spark, sf)
    of = F.col("query_id") * 8
    vector = None
    for s, intent in enumerate((None, *INTENTS)):
        rows = nearest.usable(ideas if intent is None else ideas.where(F.col("intent") == intent), "id", "embedding", DIM)
        one = nearest.knn(points, rows, 2 * K, DIM, with_self=True).withColumn("query_id", of + s)
        vector = one if vector is None else vector.unionByName(one)
    vector, _ = materialize(vector, f"{shared_dir(spark)}/vector")
    kinds = ideas.select("id", "intent")
    wanted = F.get(F.array(*[F.lit(i) for i in INTENTS]), (F.col("query_id") % 8 - 1).cast("int"))
    asked = _topic_texts(spark, sf).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(INTENTS))))).select((of + F.col("s")).alias("query_id"), "text")
    only = lambda hits: hits.join(kinds, "id").where((F.col("query_id") % 8 == 0) | (F.col("intent") == wanted)).select(hits.columns)
    return vector, search.rrf([vector, search.bm25(asked, _idea_texts(spark, sf), 2 * K, only=only)], K)


def multi_search_all(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies in this order: fused, vector, and the fused one of each intent, narrowed before its cut."""
    vector, fused = _by_strategy(spark, sf)
    near = vector.select("query_id", "id", F.round(1 - F.col("score"), 6).alias("distance"))
    fused, _ = materialize(fused.join(near, ["query_id", "id"], "left"), f"{shared_dir(spark)}/fused")
    back = lambda df, s: df.where(F.col("query_id") % 8 == s).select(F.floor(F.col("query_id") / 8).cast("bigint").alias("query_id"), "id", "distance")
    semantic = vector.where(F.col("rank") <= K).withColumn("distance", F.round(1 - F.col("score"), 6))
    return search.multi_search([back(fused, 0), back(semantic, 0), *[back(fused, s) for s in range(1, len(INTENTS) + 1)]], MOST)


def _researched(spark, sf) -> DataFrame:
    vector, keyword = _both(spark, sf)
    vector, _ = materialize(vector, f"{shared_dir(spark)}/vector")
    top = search.research(vector.where(F.col("rank") <= K), search.rrf([vector, keyword], K), 2 * K)
    top, _ = materialize(top, f"{shared_dir(spark)}/top")
    ideas, relations = _t(spark, sf, "ideas", "relations")
    ideas = memory.visible(ideas)
    # An idea without a session is in none with any other: its own id stands in, which no hash of a name equals but by accident.
    apart = ideas.select(F.col("id"), F.coalesce(F.xxhash64("session"), F.col("id")).alias("of"))
    rows = nearest.usable(ideas, "id", "embedding", DIM).join(apart, "id")
    seeds = rows.join(top.where("rank <= 3").select("id").distinct(), "id", "left_semi")
    pairs = relations.select(F.col("from_id").alias("query_id"), F.col("to_id").alias("id")).unionByName(relations.select(F.col("to_id").alias("query_id"), F.col("from_id").alias("id")))
    return search.further(top, nearest.knn_apart(seeds, rows, pairs, 3, DIM, apart="of"))


def research_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and fused list of each topic, and for the first three ideas the three nearest of other sessions not related to them."""
    return _researched(spark, sf)


def research_report(spark: SparkSession, sf: str) -> DataFrame:
    ideas, spans = _t(spark, sf, "ideas", "spans")
    return search.report(_researched(spark, sf), memory.with_topic(ideas, spans))


def research_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return search.timeline(_researched(spark, sf), table(spark, sf, "ideas").select("id", memory.when_said().alias("at")))


def topic_subclusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.subclusters(clusters.topic_ideas(*_t(spark, sf, "ideas", "spans"), DIM))


def split_topics(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.split(topic_subclusters(spark, sf))


def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    """What the documents' technologies and concepts are among those of the messages."""
    met = lambda df, text: df.select(F.explode(tx.extract_entities(F.col(text))).alias("e")).select("e.name", "e.type").where("type <> 'file'")
    said, _ = materialize(met(records.messages(table(spark, sf, "synthetic_conversation")), "content").withColumn("id", F.xxhash64("name", "type")), f"{shared_dir(spark)}/said")
    golden = said.groupBy("id").agg(F.first("name").alias("canonical_name"), F.first("type").alias("type"))
    names, _ = materialize(met(table(spark, sf, "documents"), "text").select("name").distinct(), f"{shared_dir(spark)}/names")
    return entities.search_entities(names, golden, said.select(F.col("id").alias("golden_id"))).drop("golden_id")


def executed_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations made from lines: each idea follows its span's first, unless it is known to."""
    ideas, relations = _t(spark, sf, "ideas", "relations")
    first = ideas.where("span_id IS NOT NULL").groupBy("span_id").agg(F.min("id").alias("to_id"))
    proposed = ideas.join(first, "span_id").where("id <> to_id").select("source_file", F.col("source_line").alias("from_line"), "to_id", F.when(F.col("intent") == "solution", "builds_on").alias("type"))
    return graph.executed_relations(proposed, ideas, relations)


def stored_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the later ideas are new beside the earlier ones."""
    ideas = table(spark, sf, "ideas")
    late = F.coalesce(F.col("created_at").cast("timestamp") >= LATER, F.lit(False))
    return lifecycle.store_ideas(ideas.where(~late), ideas.where(late)).select("id")


def linked_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Links by nearness, with those of topics of one project set in their place by hand."""
    ideas, spans, topics = _t(spark, sf, "ideas", "spans", "topics")
    centres = clusters.centroids(clusters.topic_ideas(ideas, spans, DIM), "topic_id", DIM).select(F.col("topic_id").alias("id"), "v")
    near = graph.best_links(graph.topic_links(centres, lifecycle.topic_times(topics, spans), 0.8)).withColumn("link_type", F.lit("semantic"))
    first = topics.where("project_id IS NOT NULL").groupBy("project_id").agg(F.min("id").alias("topic_id"))
    by_hand = topics.join(first, "project_id").where("id <> topic_id").select("topic_id", F.col("id").alias("related_topic_id"), F.lit(1.0).alias("similarity"), F.lit("manual").alias("link_type"))
    return graph.link_topics(near, by_hand)


def topic_names(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.topic_names(records.messages(table(spark, sf, "synthetic_conversation")))


QUERIES = {
    f.__name__: f
    for f in (
        multi_search_all, research_deep, research_report, research_timeline, topic_subclusters, split_topics, entity_search, executed_relations, stored_ideas, linked_topics, topic_names,
    )
}

_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY {}) AS INTEGER) AS rank"
_NEAR = "rows_ AS (SELECT vec.* FROM vec SEMI JOIN (SELECT id FROM ideas WHERE {}) USING (id))".format(VISIBLE)
_FUSE = "(SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS share FROM vl UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM kl)"
_ST = "st AS (SELECT * FROM (VALUES (0, NULL), {}) t(s, want))".format(", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(INTENTS)))
_MULTI = _bm25("kl", "SELECT id * 8 + s AS query_id, canonical_name AS text FROM topics, st", _IDEA_TEXTS, 20).replace(
    "FROM kl_s  QUALIFY", "FROM (SELECT x.* FROM kl_s x JOIN st ON st.s = x.query_id % 8 JOIN ideas i ON i.id = x.id WHERE want IS NULL OR i.intent = want) QUALIFY"
)
_RESEARCH = f"""WITH {VECTORS}, {CENTROIDS}, {_NEAR},
vl AS (SELECT topic_id AS query_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(list_cosine_similarity(centres.v, rows_.v), 9) DESC, id) AS INTEGER) AS rank, id FROM centres, rows_ QUALIFY rank <= 20),
{_bm25('kl', "SELECT id AS query_id, canonical_name AS text FROM topics", _IDEA_TEXTS, 20)},
hl AS (SELECT query_id, {_RANK.format('s DESC, id')}, id FROM (SELECT query_id, id, round(sum(share), 9) AS s FROM {_FUSE} GROUP BY 1, 2) QUALIFY rank <= 10),
j AS (SELECT coalesce(a.query_id, hl.query_id) AS query_id, coalesce(a.id, hl.id) AS id, a.rank AS v, hl.rank AS h FROM (SELECT * FROM vl WHERE rank <= 10) a FULL JOIN hl ON a.query_id = hl.query_id AND a.id = hl.id),
z AS (SELECT query_id, max(rank) AS size FROM vl WHERE rank <= 10 GROUP BY 1),
js AS (SELECT query_id, id, CAST(CASE WHEN v IS NOT NULL AND h IS NOT NULL THEN least(v, h) - 0.5 WHEN h IS NULL THEN v ELSE h + coalesce(size, 0) END AS DOUBLE) AS score,
  CASE WHEN v IS NOT NULL AND h IS NOT NULL THEN 'both' WHEN h IS NULL THEN 'vector' ELSE 'keyword' END AS found FROM j LEFT JOIN z USING (query_id)),
top AS (SELECT query_id, {_RANK.format('score, id')}, id, score, found FROM js QUALIFY rank <= 20),
rel AS (SELECT from_id AS a, to_id AS b FROM relations UNION SELECT to_id, from_id FROM relations),
sd AS (SELECT DISTINCT id AS seed FROM top WHERE rank <= 3),
cand AS (SELECT seed, r.id, round(list_cosine_similarity(q.v, r.v), 9) AS s FROM sd JOIN rows_ q ON q.id = seed JOIN ideas qi ON qi.id = seed, rows_ r JOIN ideas ri ON ri.id = r.id
  WHERE r.id <> seed AND (qi.session IS NULL OR ri.session IS NULL OR qi.session <> ri.session)),
nb AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY s DESC, id) AS n FROM (SELECT cand.* FROM cand ANTI JOIN rel ON rel.a = cand.seed AND rel.b = cand.id) QUALIFY n <= 3),
af AS (SELECT top.query_id, nb.id, min((top.rank, n, seed)) AS f FROM top JOIN nb ON nb.seed = top.id WHERE top.rank <= 3 GROUP BY 1, 2),
ag AS (SELECT af.* FROM af ANTI JOIN top ON top.query_id = af.query_id AND top.id = af.id),
deep AS (SELECT query_id, rank, id, score, found, CAST(NULL AS BIGINT) AS similar_to FROM top
  UNION ALL SELECT query_id, CAST(size + row_number() OVER (PARTITION BY query_id ORDER BY f, id) AS INTEGER), id, NULL, 'similar', f[3] FROM ag JOIN (SELECT query_id, max(rank) AS size FROM top GROUP BY 1) USING (query_id))"""

SQL = {
    "multi_search_all": f"""WITH {VECTORS}, {CENTROIDS}, {_NEAR}, {_ST},
      base AS MATERIALIZED (SELECT topic_id, id, round(list_cosine_similarity(centres.v, rows_.v), 9) AS score FROM centres, rows_),
      vl AS (SELECT topic_id * 8 + s AS query_id, CAST(row_number() OVER (PARTITION BY topic_id, s ORDER BY score DESC, base.id) AS INTEGER) AS rank, base.id, score FROM base JOIN ideas i ON i.id = base.id JOIN st ON want IS NULL OR i.intent = want QUALIFY rank <= 20),
      {_MULTI}, hl AS (SELECT query_id, {_RANK.format('s DESC, id')}, id FROM (SELECT query_id, id, round(sum(share), 9) AS s FROM {_FUSE} GROUP BY 1, 2) QUALIFY rank <= 10),
      every AS (SELECT hl.query_id // 8 AS query_id, hl.id, CASE WHEN hl.query_id % 8 = 0 THEN 0 ELSE hl.query_id % 8 + 1 END AS strategy, round(1 - score, 6) AS distance FROM hl LEFT JOIN vl ON vl.query_id = hl.query_id AND vl.id = hl.id
        UNION ALL SELECT query_id // 8, id, 1, round(1 - score, 6) FROM vl WHERE query_id % 8 = 0 AND rank <= 10),
      f AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY strategy) = 1)
      SELECT query_id, {_RANK.format('coalesce(distance, 999), id')}, id, strategy, distance FROM f QUALIFY rank <= 15""",
    "research_deep": _RESEARCH + " SELECT * FROM deep",
    "research_report": _RESEARCH
    + """, d AS (SELECT deep.query_id, rank, session, topic_id, CASE WHEN rank <= 10 THEN coalesce(intent, 'unknown') END AS kind FROM deep JOIN ti USING (id)),
      c AS (SELECT query_id, string_agg(kind || ': ' || n, ', ' ORDER BY n DESC, kind) AS kinds FROM (SELECT query_id, kind, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
      SELECT query_id, count(*) AS ideas, count(DISTINCT session) AS sessions, count(DISTINCT topic_id) AS topics, any_value(kinds) AS kinds FROM d JOIN c USING (query_id) GROUP BY 1""",
    "research_timeline": _RESEARCH + f" SELECT query_id, strftime({SEEN}, '%Y-%m-%d') AS date, string_agg(CAST(deep.id AS VARCHAR), ',' ORDER BY rank) AS ids FROM deep JOIN ideas ON ideas.id = deep.id WHERE {SEEN} IS NOT NULL GROUP BY 1, 2",
    "executed_relations": """WITH fs AS (SELECT span_id, min(id) AS to_id FROM ideas WHERE span_id IS NOT NULL GROUP BY 1), at_ AS (SELECT source_file, source_line, min(id) AS from_id FROM ideas WHERE source_file IS NOT NULL AND source_line IS NOT NULL GROUP BY 1, 2)
      SELECT DISTINCT from_id, to_id, CASE WHEN intent = 'solution' THEN 'builds_on' ELSE 'related' END AS relation_type FROM ideas JOIN fs USING (span_id) JOIN at_ USING (source_file, source_line) WHERE id <> to_id
      EXCEPT SELECT from_id, to_id, relation_type FROM relations""",
    "stored_ideas": f"""WITH i AS (SELECT *, coalesce(created_at >= TIMESTAMP '{LATER}', false) AS late FROM ideas)
      SELECT id FROM i WHERE late AND (source_file IS NULL OR source_line IS NULL) UNION ALL
      SELECT min(id) FROM i WHERE source_file IS NOT NULL AND source_line IS NOT NULL GROUP BY source_file, source_line HAVING bool_and(late)""",
    "linked_topics": f"""WITH {VECTORS}, {CENTROIDS}, n AS (SELECT a.topic_id, b.topic_id AS related_topic_id, round(round(list_cosine_similarity(a.v, b.v), 9), 6) AS similarity FROM centres a JOIN centres b ON a.topic_id <> b.topic_id AND a.topic_id IN (SELECT id FROM topics) AND b.topic_id IN (SELECT id FROM topics)
        WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.8 QUALIFY row_number() OVER (PARTITION BY a.topic_id ORDER BY round(round(list_cosine_similarity(a.v, b.v), 9), 6) DESC, b.topic_id) <= 3),
      h AS (SELECT min(id) OVER (PARTITION BY project_id) AS topic_id, id AS related_topic_id FROM topics WHERE project_id IS NOT NULL)
      SELECT topic_id, related_topic_id, 1.0::DOUBLE AS similarity, 'manual' AS link_type FROM h WHERE topic_id <> related_topic_id
      UNION ALL SELECT n.*, 'semantic' FROM n ANTI JOIN h ON h.topic_id = n.topic_id AND h.related_topic_id = n.related_topic_id""",
    "topic_names": _MESSAGES
    + f""", h AS (SELECT session, content[:200] AS name FROM msg WHERE session IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY sent_us IS NULL, sent_us, source_file NULLS FIRST, line_num NULLS FIRST, rec_id) = 1),
      c AS (SELECT session, {_clean('name')} AS name FROM h)
      SELECT session, CASE WHEN length(lower(coalesce(name, ''))) < 5 OR regexp_matches(lower(coalesce(name, '')), '{_any(tx.BAD_NAMES)}') THEN 'Discussion' ELSE name END AS name FROM c""",
}
