"""Queries on records, messages and the relations between ideas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators import batching, clusters, entities, graph, lifecycle, nearest, records
from ..operators.ordering import lay_out, running
from ..session import table
from .shared import CENTROIDS, SPANS, VECTORS
from .structure import RECORD_TEXTS


FAR = 6


def _records(spark, sf):
    return table(spark, sf, "synthetic_conversation")


def _messages(spark, sf):
    return records.messages(_records(spark, sf))


def _ideas(spark, sf):
    return table(spark, sf, "ideas")


def _relations(spark, sf):
    return table(spark, sf, "relations")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf)
    return m.select("rec_id", "session", "source_file", "line_num", "role", F.char_length("content").alias("size"), F.unix_micros("sent_at").alias("sent_us"), "has_tool_use")


def filter_reason(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf)
    return m.select("rec_id", tx.filter_reason(F.col("content"), F.col("has_tool_use")).alias("reason"))


def indexable_by_session(spark: SparkSession, sf: str) -> DataFrame:
    return records.indexable(_messages(spark, sf)).groupBy("session").agg(F.count("*").alias("n"), F.sum(tx.estimate_tokens(F.col("content"))).alias("tokens"))


def review_ideas(spark: SparkSession, sf: str) -> DataFrame:
    return records.filter_counts(_ideas(spark, sf))


def classify_messages(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    m = _messages(spark, sf).select("rec_id", "content", tx.classify_intent(c).alias("intent"))
    return m.select("rec_id", "intent", tx.assess_confidence(c, F.col("intent")).alias("confidence"), tx.topic_shift(c).alias("shift"), tx.subtopic(c).alias("deeper"), tx.back_to_parent(c).alias("back"))


def topic_turns(spark: SparkSession, sf: str) -> DataFrame:
    return batching.topic_turns(_messages(spark, sf))


def extract_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(tx.extract_entities(F.col("text"))).alias("e"))
    return rows.select("doc_id", F.col("e.name").alias("name"), F.col("e.type").alias("type"))


def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).select("session", F.explode(tx.extract_entities(F.col("content"))).alias("e"))
    return rows.groupBy(F.col("e.name").alias("name"), F.col("e.type").alias("type")).agg(F.count("*").alias("mentions"), F.countDistinct("session").alias("sessions"))


def session_names(spark: SparkSession, sf: str) -> DataFrame:
    files = _records(spark, sf).select("source_file").distinct()
    return files.select("source_file", records.session_of(F.concat(F.lit("/"), F.col("source_file"))).alias("session"), records.file_stem(F.col("source_file")).alias("stem"))


def source_context(spark: SparkSession, sf: str) -> DataFrame:
    return records.around(_ideas(spark, sf), _messages(spark, sf), "id", "source_file", "source_line", 5, 5)


def message_context(spark: SparkSession, sf: str) -> DataFrame:
    return records.neighbours_in_file(_messages(spark, sf), 2, 2)


def idea_times(spark: SparkSession, sf: str) -> DataFrame:
    """The time of each idea's message, from the log where the idea has none."""
    log = _messages(spark, sf).groupBy("source_file", F.col("line_num").alias("source_line")).agg(F.min("sent_at").alias("sent_at"))
    rows = _ideas(spark, sf).select("id", "source_file", "source_line", "message_time").join(log, ["source_file", "source_line"], "left")
    return rows.select("id", F.unix_micros(F.coalesce(F.col("message_time").cast("timestamp"), "sent_at")).alias("time_us"))


def gap_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batching.gap_batches(_messages(spark, sf), 300.0).drop("tokens")


def token_packs(spark: SparkSession, sf: str) -> DataFrame:
    return batching.token_packs(batching.batch_sizes(batching.gap_batches(_messages(spark, sf), 300.0)), 2000)


def clean_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clean_relations(_relations(spark, sf), _ideas(spark, sf))


def idea_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_relations(spark, sf))


def expand_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.walk(_ideas(spark, sf), _relations(spark, sf), 1).select("seed", "id", "hop")


def trace(spark: SparkSession, sf: str) -> DataFrame:
    return graph.walk(_ideas(spark, sf), _relations(spark, sf), 3, "out")


def find_path(spark: SparkSession, sf: str) -> DataFrame:
    return graph.paths(graph.walk(_ideas(spark, sf).where("id % 50 = 0"), _relations(spark, sf), 3))


def find_path_far(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of up to six hops, the most that the reference lets a caller ask for; find_path has the three that its SQL states."""
    return graph.paths(graph.walk(_ideas(spark, sf).where("id % 50 = 0"), _relations(spark, sf), FAR))


def detect_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.detected_relations(_ideas(spark, sf))


def detect_relations_vector(spark: SparkSession, sf: str) -> DataFrame:
    return graph.detected_relations(_ideas(spark, sf), by_vector=True)


def auto_link(spark: SparkSession, sf: str) -> DataFrame:
    spans, topics = table(spark, sf, "spans"), table(spark, sf, "topics")
    centres = clusters.centroids(clusters.topic_ideas(_ideas(spark, sf), spans), "topic_id").select(F.col("topic_id").alias("id"), "v")
    return graph.topic_links(centres, lifecycle.topic_times(topics, spans), 0.8)


def project_tree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.project_tree(table(spark, sf, "projects"), table(spark, sf, "topics"), table(spark, sf, "spans"))


def semantic_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Shifts in each session, by the similarity of each idea to the one before it that has a usable vector."""
    rows = _ideas(spark, sf).where(F.col("session").isNotNull())
    good = nearest.usable(rows, "id", "embedding", 64).join(rows.select("id", "session", F.coalesce("message_time", "created_at").alias("at")), "id")
    by, order = ["session"], ["at", "id"]
    pairs = running(lay_out(good, by, order), by, order, before={"w": F.col("v")}).where("w IS NOT NULL")
    return batching.semantic_shift(pairs.select("session", "at", "id", F.round(cosine(F.col("v"), F.col("w")), 9).alias("similarity")))


def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """Topics whose names are alike, letter by letter."""
    return entities.similar_pairs(table(spark, sf, "topics").select("id", F.col("canonical_name").alias("name")))



QUERIES = {
    f.__name__: f
    for f in (
        messages, filter_reason, indexable_by_session, review_ideas, classify_messages, topic_turns, extract_entities, entity_mentions, session_names, source_context, message_context,
        idea_times, gap_batches, token_packs, clean_relations, idea_relations, expand_relations, trace, find_path, find_path_far, detect_relations, detect_relations_vector, auto_link, project_tree,
        semantic_shift, similar_names,
    )
}

_Q = lambda p: tx.any_of(p).replace("'", "''")
_M = lambda p: tx.words_of(p).replace("'", "''")
_LIST = lambda p: ", ".join("'" + x.replace("'", "''") + "'" for x in p)
_TIME = r"""CASE WHEN regexp_full_match(timestamp, '[0-9]{1,15}') THEN CAST(timestamp AS BIGINT) * 1000
  WHEN regexp_full_match(timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?')
  THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches(timestamp, '(Z|[+-][0-9]{2}(:?[0-9]{2})?)$') AND NOT regexp_full_match(timestamp, '.{10}') THEN timestamp ELSE timestamp || 'Z' END AS TIMESTAMPTZ)) END"""
_MESSAGES = RECORD_TEXTS.rstrip() + rf""", msg AS (SELECT rec_id, session, source_file, line_num, type AS role, txt AS content, {_TIME} AS sent_us, type = 'assistant' AND coalesce(uses_tool, false) AS has_tool_use
FROM texts WHERE regexp_matches(txt, '[^\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}\x{{0b}}]'))"""


def _reason(content: str, tool: str) -> str:
    t = rf"regexp_replace(coalesce({content}, ''), '^[\s\p{{Z}}\x{{85}}\x{{0b}}]+|[\s\p{{Z}}\x{{85}}\x{{0b}}]+$', '', 'g')"
    low, starts = f"lower({t})", "|".join(s.replace(".", r"\.") for s in tx.GREETING_STARTS)
    hit = lambda p: f"regexp_matches({low}, '{_Q(p)}')"
    return f"""CASE WHEN length({t}) = 0 THEN 'empty' WHEN length({t}) < 20 THEN 'too_short' WHEN {low} IN ({_LIST(tx.GREETINGS)}) THEN 'greeting' WHEN {low} IN ({_LIST(tx.ACKNOWLEDGEMENTS)}) THEN 'acknowledgment'
WHEN length({t}) < 50 AND regexp_matches({low}, '^(?:{starts})') THEN 'greeting_response' WHEN {hit(tx.NARRATION)} THEN 'tool_narration' WHEN {hit(tx.SYSTEM)} THEN 'system_message' WHEN {hit(tx.WARMUPS)} THEN 'warmup'
WHEN length({t}) < 50 AND {hit(tx.INSTRUCTIONS)} THEN 'short_instruction' WHEN length({t}) < 80 AND {hit(tx.PREAMBLES)} AND NOT {hit(tx.SUBSTANTIVE)} THEN 'preamble'
WHEN {tool} AND length({t}) < 100 AND {hit(tx.PREAMBLES)} THEN 'tool_preamble' WHEN {tool} AND length({t}) < 60 THEN 'short_tool_intro' END"""


_LOW = r"regexp_replace(lower(content), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches({_LOW}, '{_Q(p)}') THEN '{i}'" for i, p in tx.INTENTS.items()) + " ELSE 'context' END"
_CONF = "CASE intent " + " ".join(f"WHEN '{i}' THEN {v}::DOUBLE" for i, v in tx.CONFIDENCE.items()) + " ELSE 0.5 END"
_TECH = "[" + ", ".join(f"{{'w': '{t}', 'n': '{tx.CANONICAL_NAMES.get(t, t)}'}}" for t in tx.TECHNOLOGIES) + "]"
_CONCEPTS = "[" + ", ".join(f"regexp_extract(lower({{0}}), '{p}', 1)" for p in tx.CONCEPTS) + "]"


def _entities(key: str, text: str, source: str) -> str:
    concepts = _CONCEPTS.format(f"coalesce({text}, '')")
    return rf"""SELECT DISTINCT {key}, name, type FROM (
SELECT {key}, unnest(list_transform(list_filter({_TECH}, lambda t: contains(lower(coalesce({text}, '')), t.w)), lambda t: t.n)) AS name, 'technology' AS type FROM {source}
UNION ALL SELECT {key}, unnest(regexp_extract_all(coalesce({text}, ''), '{tx.FILE_PATH}')), 'file' FROM {source}
UNION ALL SELECT {key}, unnest(list_filter({concepts}, lambda c: c <> '')), 'concept' FROM {source})"""


_STEPS = {
    "both": "st AS (SELECT from_id AS id, to_id AS nx FROM relations WHERE from_id <> to_id UNION SELECT to_id, from_id FROM relations WHERE from_id <> to_id)",
    "out": "st AS (SELECT DISTINCT from_id AS id, to_id AS nx FROM relations WHERE from_id <> to_id)",
}


def _walk(direction: str, hops: int, seeds: str = "ideas") -> str:
    out = f"WITH {_STEPS[direction]}, f0 AS (SELECT DISTINCT id AS seed, id, 0 AS hop, CAST(NULL AS BIGINT) AS parent FROM {seeds}), w0 AS (SELECT * FROM f0)"
    for h in range(1, hops + 1):
        out += f", f{h} AS (SELECT seed, nx AS id, {h} AS hop, min(id) AS parent FROM (SELECT f.seed, st.nx, f.id FROM f{h - 1} f JOIN st ON st.id = f.id LEFT JOIN w{h - 1} w ON w.seed = f.seed AND w.id = st.nx WHERE w.id IS NULL) GROUP BY seed, nx), w{h} AS (SELECT * FROM w{h - 1} UNION ALL SELECT * FROM f{h})"
    return out


_PLACED = f"pl AS (SELECT session, id, content, intent, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY session ORDER BY coalesce(message_time, created_at) NULLS FIRST, id) AS place FROM ideas WHERE session IS NOT NULL), pr AS (SELECT a.id, b.id AS other_id, a.place - b.place AS back, a.content, b.content AS other, a.intent, b.intent AS other_intent, a.v, b.v AS w FROM pl a JOIN pl b ON a.session = b.session AND b.place BETWEEN a.place - 10 AND a.place - 1)"
_SIG = rf"list_filter(list_distinct(regexp_extract_all(lower(coalesce({{0}}, '')), '\b\w{{{{5,}}}}\b')), lambda x: x NOT IN ({_LIST(tx.OVERLAP_STOPWORDS)}))"
_OVERLAP = f"len(list_intersect({_SIG.format('content').replace('{{', '{').replace('}}', '}')}, {_SIG.format('other').replace('{{', '{').replace('}}', '}')})) >= 2"
_SUP, _ADD = (f"regexp_matches(lower(content), '{_M(p)}')" for p in (tx.SUPERSEDES, tx.BUILDS_ON))
_ANS = "coalesce(intent = 'solution' AND other_intent IN ('question', 'problem'), false)"
_BATCHES = (
    _MESSAGES
    + """, mg AS (SELECT *, row_number() OVER w AS place, last_value(sent_us IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM msg WINDOW w AS (PARTITION BY source_file ORDER BY line_num NULLS FIRST, rec_id)),
mr AS (SELECT *, max(CASE WHEN place = 1 OR sent_us - earlier > 300000000 THEN place END) OVER (PARTITION BY source_file ORDER BY place) AS run FROM mg),
mb AS (SELECT *, first_value(line_num) OVER (PARTITION BY source_file, run + (place - run) // 100 * 100 ORDER BY place) AS batch_line FROM mr)"""
)

SQL = {
    "messages": _MESSAGES + " SELECT rec_id, session, source_file, line_num, role, CAST(length(content) AS INTEGER) AS size, sent_us, has_tool_use FROM msg",
    "filter_reason": _MESSAGES + f" SELECT rec_id, {_reason('content', 'has_tool_use')} AS reason FROM msg",
    "indexable_by_session": _MESSAGES + f" SELECT session, count(*) AS n, CAST(sum(length(content) // 4) AS BIGINT) AS tokens FROM msg WHERE {_reason('content', 'has_tool_use')} IS NULL GROUP BY session",
    "review_ideas": f"SELECT coalesce({_reason('content', 'false')}, 'kept') AS reason, count(*) AS n FROM ideas GROUP BY 1",
    "classify_messages": _MESSAGES
    + f""", c AS (SELECT *, {_INTENT} AS intent FROM msg)
SELECT rec_id, intent, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, {_CONF} - CASE WHEN regexp_matches(lower(content), '{_M(tx.TENTATIVE)}') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(content), '{_M(tx.FIRM)}') THEN 0.1::DOUBLE ELSE 0 END)), 2) AS confidence,
regexp_matches(lower(content), '{_Q(tx.SHIFTS)}') AS shift, regexp_matches(lower(content), '{_Q(tx.SUBTOPICS)}') AS deeper, regexp_matches(lower(content), '{_Q(tx.RETURNS)}') AS back FROM c""",
    "topic_turns": _MESSAGES + f" SELECT rec_id, CASE WHEN regexp_matches(lower(content), '{_Q(tx.RETURNS)}') THEN 'back' WHEN regexp_matches(lower(content), '{_Q(tx.SUBTOPICS)}') THEN 'deeper' WHEN regexp_matches(lower(content), '{_Q(tx.SHIFTS)}') THEN 'shift' ELSE 'none' END AS turn FROM msg",
    "extract_entities": _entities("doc_id", "text", "documents"),
    "entity_mentions": _MESSAGES + f", e AS ({_entities('rec_id', 'content', 'msg')}) SELECT name, type, count(*) AS mentions, count(DISTINCT session) AS sessions FROM e JOIN msg USING (rec_id) GROUP BY 1, 2",
    "session_names": r"SELECT DISTINCT source_file, regexp_extract('/' || source_file, '/projects/([^/]+)/', 1) AS session, regexp_extract(source_file, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM synthetic_conversation",
    "source_context": _MESSAGES + " SELECT i.id, m.source_file, m.line_num, m.line_num = i.source_line AS is_source, m.content[:500] AS content FROM ideas i JOIN msg m ON m.source_file = i.source_file AND m.line_num BETWEEN i.source_line - 5 AND i.source_line + 5",
    "message_context": _MESSAGES
    + ", p AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_num, rec_id) AS place FROM msg WHERE source_file IS NOT NULL) SELECT a.rec_id, b.rec_id AS other_id, CAST(b.place - a.place AS BIGINT) AS distance FROM p a JOIN p b ON a.source_file = b.source_file AND b.place BETWEEN a.place - 2 AND a.place + 2 AND b.place <> a.place AND b.line_num BETWEEN a.line_num - 20 AND a.line_num + 20",
    "idea_times": _MESSAGES + ", l AS (SELECT source_file, line_num, min(sent_us) AS s FROM msg GROUP BY 1, 2) SELECT id, coalesce(epoch_us(message_time), s) AS time_us FROM ideas i LEFT JOIN l ON l.source_file = i.source_file AND l.line_num = i.source_line",
    "gap_batches": _BATCHES + " SELECT source_file, line_num, rec_id, batch_line, place FROM mb",
    "token_packs": _BATCHES.replace("WITH stood", "WITH RECURSIVE stood", 1)
    + """, sz AS (SELECT source_file, batch_line, CAST(sum(length(content) // 4) AS BIGINT) AS tokens FROM mb WHERE source_file IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY batch_line) AS n FROM sz),
k AS (SELECT source_file, n, batch_line, tokens AS total, batch_line AS pack_line FROM o WHERE n = 1 UNION ALL
SELECT o.source_file, o.n, o.batch_line, CASE WHEN k.total + o.tokens > 2000 THEN o.tokens ELSE k.total + o.tokens END, CASE WHEN k.total + o.tokens > 2000 THEN o.batch_line ELSE k.pack_line END FROM k JOIN o ON o.source_file = k.source_file AND o.n = k.n + 1)
SELECT source_file, batch_line, pack_line FROM k""",
    "clean_relations": f"SELECT min(id) AS id, from_id, to_id, CASE WHEN relation_type IN ({_LIST(graph.TYPES)}) THEN relation_type ELSE 'relates_to' END AS relation_type FROM relations WHERE from_id IN (SELECT id FROM ideas) AND to_id IN (SELECT id FROM ideas) GROUP BY ALL",
    "idea_relations": "SELECT id, relation_type, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT from_id AS id, relation_type, 1 AS o, 0 AS i FROM relations UNION ALL SELECT to_id, relation_type, 0, 1 FROM relations) GROUP BY 1, 2",
    "expand_relations": _walk("both", 1) + " SELECT seed, id, hop FROM w1",
    "trace": _walk("out", 3) + " SELECT * FROM w3",
    "find_path": _walk("both", 3, "ideas WHERE id % 50 = 0")
    + """, p1 AS (SELECT seed, id, hop, seed || '/' || id AS path FROM f1), p2 AS (SELECT f2.seed, f2.id, f2.hop, path || '/' || f2.id AS path FROM f2 JOIN p1 ON p1.seed = f2.seed AND p1.id = f2.parent),
p3 AS (SELECT f3.seed, f3.id, f3.hop, path || '/' || f3.id AS path FROM f3 JOIN p2 ON p2.seed = f3.seed AND p2.id = f3.parent)
SELECT seed, id, hop, CAST(seed AS VARCHAR) AS path FROM f0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""",
    "find_path_far": _walk("both", FAR, "ideas WHERE id % 50 = 0")
    + ", p0 AS (SELECT seed, id, hop, CAST(seed AS VARCHAR) AS path FROM f0)"
    + "".join(f", p{h} AS (SELECT f{h}.seed, f{h}.id, f{h}.hop, path || '/' || f{h}.id AS path FROM f{h} JOIN p{h - 1} p ON p.seed = f{h}.seed AND p.id = f{h}.parent)" for h in range(1, FAR + 1))
    + " "
    + " UNION ALL ".join(f"SELECT * FROM p{h}" for h in range(FAR + 1)),
    "detect_relations": f"""WITH {_PLACED}, d AS (SELECT id, other_id, back, {_OVERLAP} AS shared, {_SUP} AS sup, {_ADD} AS add_, {_ANS} AS ans, coalesce(intent = other_intent, false) AS alike FROM pr)
SELECT id AS from_id, other_id AS to_id, 'supersedes' AS relation_type FROM d WHERE sup AND (alike OR shared) QUALIFY row_number() OVER (PARTITION BY id ORDER BY back) = 1
UNION ALL SELECT id, other_id, 'builds_on' FROM d WHERE add_ AND shared QUALIFY row_number() OVER (PARTITION BY id ORDER BY back) = 1 UNION ALL SELECT id, other_id, 'answers' FROM d WHERE ans AND shared""",
    "detect_relations_vector": f"""WITH {_PLACED}, d AS (SELECT *, CASE WHEN len(v) = len(w) AND list_max(list_transform(v, lambda x: abs(x))) > 0 AND list_max(list_transform(w, lambda x: abs(x))) > 0 THEN list_cosine_similarity(v, w) ELSE 0 END AS s FROM pr),
k AS (SELECT id AS from_id, other_id AS to_id, CASE WHEN {_ANS} THEN 'answers' WHEN {_SUP} THEN 'supersedes' WHEN {_ADD} THEN 'builds_on' WHEN s > 0.85 THEN 'relates_to' END AS relation_type FROM d WHERE s >= 0.75) SELECT * FROM k WHERE relation_type IS NOT NULL""",
    "auto_link": f"""WITH {VECTORS}, {CENTROIDS}, s AS (SELECT topic_id, min(start_time) AS a, max(coalesce(end_time, start_time)) AS b FROM sp GROUP BY topic_id), tt AS (SELECT t.id, coalesce(a, first_seen) AS f, coalesce(b, last_seen) AS l FROM topics t LEFT JOIN s ON s.topic_id = t.id)
SELECT x.topic_id, y.topic_id AS related_topic_id, round(round(list_cosine_similarity(x.v, y.v), 9), 6) AS similarity, coalesce(p.f <= q.l AND q.f <= p.l, false) AS time_overlap
FROM centres x JOIN centres y ON x.topic_id <> y.topic_id JOIN tt p ON p.id = x.topic_id JOIN tt q ON q.id = y.topic_id WHERE round(list_cosine_similarity(x.v, y.v), 9) >= 0.8""",
    "project_tree": f"""WITH {SPANS}, t AS (SELECT id, name, coalesce(project_id, 0) AS p FROM topics)
SELECT CAST(id AS VARCHAR) AS path, 'project' AS kind, id, name, 0 AS depth FROM (SELECT id, name FROM projects UNION ALL SELECT DISTINCT CAST(0 AS BIGINT), '(Unassigned)' FROM t WHERE p = 0)
UNION ALL SELECT p || '/' || id, 'topic', id, name, 1 FROM t UNION ALL SELECT p || '/' || topic_id || '/' || sp.id, 'span', sp.id, sp.name, 2 FROM sp JOIN t ON t.id = sp.topic_id""",
    "semantic_shift": f"""WITH {VECTORS}, o AS (SELECT i.session, vec.id, v, coalesce(message_time, created_at) AS said FROM vec JOIN ideas i ON i.id = vec.id WHERE session IS NOT NULL),
l AS (SELECT *, lag(v) OVER (PARTITION BY session ORDER BY said NULLS FIRST, id) AS w FROM o), s AS (SELECT session, id, said, round(list_cosine_similarity(v, w), 9) AS s0 FROM l WHERE w IS NOT NULL),
h AS (SELECT *, lag(s0) OVER k AS s1, lag(s0, 2) OVER k AS s2 FROM s WINDOW k AS (PARTITION BY session ORDER BY said NULLS FIRST, id))
SELECT session, id, s0 < 0.55::DOUBLE - 0.15::DOUBLE OR (s0 < 0.55 AND (coalesce(s1 < 0.55, false) OR coalesce(s2 < 0.55, false))) AS shift FROM h""",
}
