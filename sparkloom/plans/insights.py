"""Queries that count, review and lay out the memory over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics, lifecycle
from ..session import table
from .shared import PERIODS, SEEN, SPANS, TOPICAL, VISIBLE

NOW = "2021-03-20 00:00:00"


def _t(*names):
    return lambda spark, sf: [table(spark, sf, n) for n in names]


def _q(names, make):
    read = _t(*names)
    return lambda spark, sf: make(*read(spark, sf))


def _string(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


QUERIES = {
    "list_topics": _q(("topics", "spans", "ideas"), analytics.list_topics),
    "list_projects": _q(("projects", "topics", "spans", "ideas"), analytics.list_projects),
    "list_sessions": _q(("ideas", "spans"), analytics.list_sessions),
    "stats": _q(("ideas", "spans", "topics", "relations"), analytics.totals),
    "key_ideas": _q(("ideas",), lambda i: analytics.key_ideas(i.where("span_id IS NOT NULL"), ["span_id"])),
    "activity_day": _q(("ideas",), lambda i: analytics.activity(i, "day")),
    "activity_week": _q(("ideas",), lambda i: analytics.activity(i, "week")),
    "activity_month": _q(("ideas",), lambda i: analytics.activity(i, "month")),
    "activity_by_intent": _q(("ideas",), lambda i: analytics.activity_by_intent(i, "week")),
    "topic_activity": _q(("ideas", "spans"), lambda i, s: analytics.topic_activity(i, s, "week")),
    "topic_timeline": _q(("topics", "spans", "ideas"), analytics.topic_timeline),
    "project_timeline": _q(("ideas", "spans"), analytics.project_timeline),
    "review_topics": _q(("topics", "spans", "ideas"), analytics.review_topics),
    "topic_history": _q(("spans", "ideas"), analytics.topic_history),
    "unanswered_questions": _q(("ideas",), analytics.unanswered_questions),
    "open_spans": _q(("spans",), analytics.open_spans),
    "reflect_group": _q(("ideas",), lambda i: analytics.reflection(i, NOW, 14)),
    "retention_score": _q(("ideas",), lambda i: i.select("id", lifecycle.retention_score(F.lit(NOW)).alias("score"))),
    "forgettable": _q(("ideas",), lambda i: lifecycle.forgettable(i, F.lit(NOW), 0.6)),
    "auto_forget": _q(("ideas",), lambda i: lifecycle.mark_forgotten(i, lifecycle.forgettable(i, F.lit(NOW), 0.6)).select("id", "forgotten")),
    "consolidation_candidates": _q(("ideas", "spans"), lambda i, s: lifecycle.consolidation(i, s, F.lit(NOW))),
    "consolidate": _q(("ideas", "spans"), lambda i, s: lifecycle.consolidate(i, s, F.lit(NOW))),
    "activate_mentions": _q(("ideas",), lambda i: lifecycle.fold_activation(i.where("span_id IS NOT NULL").select("session", F.col("span_id").alias("idea_id")))),
    "working_memory": _q(("ideas",), lambda i: lifecycle.working_memory(i, F.lit(NOW), 0.9)),
    "active_ideas": _q(("ideas",), lambda i: lifecycle.active(lifecycle.working_memory(i, F.lit(NOW), 0.9), 5)),
    "distinct_ideas": _q(("ideas",), lifecycle.distinct_ideas),
    "find_or_create_topic": _q(("spans", "topics"), lifecycle.find_or_create_topics),
    "topic_times": _q(("topics", "spans"), lifecycle.topic_times),
    "delete_forgotten": _q(("ideas", "relations"), lambda i, r: lifecycle.delete_cascade(i, r, i.where("forgotten"))[1]),
    "clean_topic_name": _q(("topics",), lambda t: t.select("id", tx.clean_topic_name(F.col("name")).alias("clean"), tx.canonical_topic(F.col("name")).alias("canonical"), tx.bad_topic_name(F.col("name")).alias("bad"))),
}

_SAID = f"epoch_us({SEEN})"
_SCORE = f"""round(greatest(0.2::DOUBLE, 1.0::DOUBLE - least(coalesce(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(created_at, message_time))) / 86400000000), 0), 365) / 90 * 0.8::DOUBLE) * 0.3::DOUBLE
  + least(1.0::DOUBLE, coalesce(access_count, 0) / 5) * 0.3::DOUBLE
  + CASE coalesce(intent, 'context') WHEN 'decision' THEN 1.0::DOUBLE WHEN 'conclusion' THEN 1.0 WHEN 'solution' THEN 0.8 WHEN 'problem' THEN 0.6 WHEN 'question' THEN 0.5 WHEN 'todo' THEN 0.7 ELSE 0.3 END * 0.4::DOUBLE, 3)"""
_BY_SPAN = "bs AS (SELECT span_id, count(*) AS n FROM ideas WHERE span_id IS NOT NULL GROUP BY span_id)"
_COUNTED = f"{SPANS}, {_BY_SPAN}, bt AS (SELECT topic_id, count(*) AS spans, coalesce(sum(n), 0) AS ideas FROM sp LEFT JOIN bs ON bs.span_id = sp.id GROUP BY topic_id), lt AS (SELECT t.id, t.name, t.project_id, coalesce(bt.spans, 0) AS span_count, CAST(coalesce(bt.ideas, 0) AS BIGINT) AS idea_count FROM topics t LEFT JOIN bt ON bt.topic_id = t.id)"
_PRESERVE = "NOT (coalesce(intent IN ('decision', 'conclusion'), false) OR coalesce(confidence >= 0.9, false))"
_OLD = f"floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000) >= 7"
_CONS = f"cons AS (SELECT topic_id, count(*) AS n, round(avg(confidence), 9) AS mean_confidence FROM ti WHERE topic_id IS NOT NULL AND {_OLD} AND {_PRESERVE} GROUP BY topic_id HAVING count(*) >= 3)"
_WM = f"wm AS (SELECT session, id AS idea_id, round(least(1.0::DOUBLE, 0.2::DOUBLE * access_count) * pow(0.9::DOUBLE, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed)) / 86400000000)), 9) AS activation FROM ideas WHERE {VISIBLE} AND last_accessed IS NOT NULL)"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _clean(c: str) -> str:
    out = _strip(c)
    for pattern, by in tx.MARKUP:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    for pattern in tx.NAME_STARTS:
        out = "regexp_replace({}, '{}', '')".format(out, pattern.replace("'", "''"))
    out = f"(SELECT CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(x[1]) || x[2:] ELSE x END FROM (SELECT {out} AS x))"
    cut = "CASE WHEN contains(y[:80], ' ') AND length(y[:80]) - strpos(reverse(y[:80]), ' ') > 40 THEN y[:length(y[:80]) - strpos(reverse(y[:80]), ' ')] ELSE y[:80] END"
    return f"(SELECT {_strip(f'CASE WHEN length(y) > 80 THEN {cut} ELSE y END')} FROM (SELECT {out} AS y))"


def _canonical(c: str) -> str:
    start = tx.CANONICAL_STARTS.replace("'", "''")
    return rf"regexp_replace(regexp_replace(regexp_replace({_strip(f'lower({c})')}, '{start}', ''), '[.:,;!?]+$', ''), '\s+', ' ', 'g')[:50]"


def _any(patterns) -> str:
    return tx.any_of(patterns).replace("'", "''")


def _activity(period: str) -> str:
    n = lambda i: f"CAST(count(*) FILTER (intent = '{i}') AS BIGINT)"
    return f"SELECT {PERIODS[period](SEEN)} AS period, count(*) AS total, {n('decision')} AS decisions, {n('question')} AS questions, {n('conclusion')} AS conclusions, count(DISTINCT session) AS sessions FROM ideas WHERE {VISIBLE} AND {SEEN} IS NOT NULL GROUP BY 1"


SQL = {
    "list_topics": f"WITH {_COUNTED} SELECT id, name, span_count, idea_count FROM lt",
    "list_projects": f"""WITH {_COUNTED}, bp AS (SELECT project_id, count(*) AS topic_count, CAST(sum(idea_count) AS BIGINT) AS idea_count FROM lt GROUP BY project_id)
      SELECT p.id, p.name, coalesce(topic_count, 0) AS topic_count, coalesce(idea_count, 0) AS idea_count FROM projects p LEFT JOIN bp ON bp.project_id = p.id
      UNION ALL SELECT NULL, '(Unassigned)', topic_count, idea_count FROM bp WHERE project_id IS NULL""",
    "list_sessions": f"""WITH {SPANS}, a AS (SELECT session, count(*) AS idea_count, min({_SAID}) AS first_us, max({_SAID}) AS last_us FROM ideas WHERE session IS NOT NULL GROUP BY session),
      b AS (SELECT session, count(*) AS span_count FROM sp WHERE session IS NOT NULL GROUP BY session)
      SELECT coalesce(a.session, b.session) AS session, coalesce(span_count, 0) AS span_count, coalesce(idea_count, 0) AS idea_count, first_us, last_us FROM a FULL JOIN b ON a.session = b.session""",
    "stats": f"""WITH {SPANS}
      SELECT 'ideas' AS section, unnest(['all', 'forgotten', 'unanswered', 'accesses', 'never_accessed', 'often_accessed']) AS name,
        CAST(unnest([count(*), count(*) FILTER (coalesce(forgotten, false)), count(*) FILTER (intent = 'question' AND NOT coalesce(answered, false)), coalesce(sum(access_count), 0), count(*) FILTER (coalesce(access_count, 0) = 0), count(*) FILTER (access_count > 5)]) AS BIGINT) AS n FROM ideas
      UNION ALL SELECT 'intent', coalesce(intent, '(none)'), count(*) FROM ideas GROUP BY 2 UNION ALL SELECT 'relation', coalesce(relation_type, '(none)'), count(*) FROM relations GROUP BY 2
      UNION ALL SELECT 'tables', 'spans', count(*) FROM sp UNION ALL SELECT 'tables', 'topics', count(*) FROM topics""",
    "key_ideas": """SELECT span_id, CAST(row_number() OVER (PARTITION BY span_id ORDER BY CASE intent WHEN 'decision' THEN 1 WHEN 'conclusion' THEN 2 ELSE 3 END, confidence DESC NULLS LAST, id) AS INTEGER) AS place, id AS idea_id, intent, content[:100] AS content
      FROM ideas WHERE span_id IS NOT NULL AND intent IN ('decision', 'conclusion', 'solution') QUALIFY place <= 3""",
    "activity_day": _activity("day"),
    "activity_week": _activity("week"),
    "activity_month": _activity("month"),
    "activity_by_intent": f"SELECT {PERIODS['week'](SEEN)} AS period, intent, count(*) AS n FROM ideas WHERE {VISIBLE} GROUP BY 1, 2",
    "topic_activity": f"WITH {SPANS}, {TOPICAL} SELECT topic_id, {PERIODS['week'](SEEN)} AS period, count(*) AS total, CAST(count(*) FILTER (intent = 'decision') AS BIGINT) AS decisions, count(DISTINCT session) AS sessions FROM ti WHERE topic_id IS NOT NULL GROUP BY 1, 2",
    "topic_timeline": f"WITH {SPANS}, {_BY_SPAN} SELECT sp.topic_id, strftime(coalesce(sp.start_time, sp.created_at), '%Y-%m-%d') AS date, sp.id AS span_id, sp.name AS span_name, coalesce(bs.n, 0) AS idea_count FROM sp JOIN topics t ON t.id = sp.topic_id LEFT JOIN bs ON bs.span_id = sp.id",
    "project_timeline": f"WITH {SPANS}, {TOPICAL} SELECT session, strftime({SEEN}, '%Y-%m-%d') AS date, count(*) AS ideas, CAST(count(*) FILTER (intent = 'decision') AS BIGINT) AS decisions, count(DISTINCT topic_id) AS topics FROM ti GROUP BY 1, 2",
    "review_topics": f"""WITH {_COUNTED}, k AS (SELECT *, {_canonical(_clean('name'))} AS key, sum(idea_count) OVER () AS whole FROM lt)
      SELECT id, name, idea_count, coalesce(idea_count > 100 OR idea_count > whole * 0.2, false) AS is_catch_all,
        regexp_matches(lower(coalesce(name, '')), '{_any(tx.REVIEW_NAMES)}') OR regexp_matches(coalesce(name, ''), '{_any(tx.REVIEW_NAMES_CASED)}') AS bad_name, idea_count = 0 AS is_empty,
        count(*) OVER (PARTITION BY key) - 1 AS duplicates FROM k""",
    "topic_history": f"""WITH {SPANS}, {_BY_SPAN}, k AS (SELECT *, trim(lower(coalesce(name, '')))[:30] AS key FROM sp)
      SELECT session, id AS span_id, name, start_line, end_line, coalesce(bs.n, 0) AS idea_count, key <> '' AND row_number() OVER (PARTITION BY session, key ORDER BY start_line NULLS FIRST, id) > 1 AS is_return FROM k LEFT JOIN bs ON bs.span_id = k.id""",
    "unanswered_questions": f"SELECT id, session, content, {_SAID} AS said_us FROM ideas WHERE {VISIBLE} AND intent = 'question' AND NOT coalesce(answered, false)",
    "open_spans": f"WITH {SPANS} SELECT session, id AS span_id, coalesce(depth, 0) AS depth FROM sp WHERE end_line IS NULL AND session IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY coalesce(depth, 0) DESC, id DESC) = 1",
    "reflect_group": f"""SELECT session, intent, CAST(row_number() OVER (PARTITION BY session, intent ORDER BY {SEEN}, id) AS INTEGER) AS place, count(*) OVER (PARTITION BY session, intent) AS n, content[:150] AS content
      FROM ideas WHERE {VISIBLE} AND {SEEN} >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY QUALIFY place <= 5""",
    "retention_score": f"SELECT id, {_SCORE} AS score FROM ideas",
    "forgettable": f"SELECT id, session, {_SCORE} AS score FROM ideas WHERE {VISIBLE} AND intent NOT IN ('decision', 'conclusion') AND {_SCORE} <= 0.6",
    "auto_forget": f"SELECT id, CASE WHEN {VISIBLE} AND coalesce(intent NOT IN ('decision', 'conclusion'), false) AND {_SCORE} <= 0.6 THEN true ELSE forgotten END AS forgotten FROM ideas",
    "consolidation_candidates": f"WITH {SPANS}, {TOPICAL}, {_CONS} SELECT * FROM cons",
    "consolidate": f"""WITH {SPANS}, {TOPICAL}, {_CONS}, f AS (SELECT ti.topic_id, cons.n AS sources, content[:100] AS c, row_number() OVER (PARTITION BY ti.topic_id ORDER BY {SEEN}, id) AS place FROM ti JOIN cons ON cons.topic_id = ti.topic_id WHERE {_OLD} AND {_PRESERVE})
      SELECT topic_id, string_agg(c, ' | ' ORDER BY place) AS content, any_value(sources) AS sources FROM f WHERE place <= 5 GROUP BY topic_id""",
    "activate_mentions": "SELECT session, span_id AS idea_id, least(1.0::DOUBLE, 1.0::DOUBLE + 0.5::DOUBLE * (count(*) - 1)) AS activation, count(*) AS mentions FROM ideas WHERE span_id IS NOT NULL GROUP BY 1, 2",
    "working_memory": f"WITH {_WM} SELECT * FROM wm WHERE activation >= 0.01",
    "active_ideas": f"WITH {_WM} SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY activation DESC, idea_id) AS INTEGER) AS rank FROM wm WHERE activation >= 0.1 QUALIFY rank <= 5",
    "distinct_ideas": "SELECT source_file, source_line, min(id) AS id, count(*) AS copies FROM ideas WHERE source_file IS NOT NULL AND source_line IS NOT NULL GROUP BY 1, 2",
    "find_or_create_topic": f"""WITH {SPANS}, n AS (SELECT id AS span_id, {_canonical('name')} AS canonical_name FROM sp WHERE length(coalesce(name, '')) > 0),
      known AS (SELECT canonical_name, min(id) AS topic_id FROM topics WHERE canonical_name IS NOT NULL GROUP BY 1),
      fresh AS (SELECT canonical_name, row_number() OVER (ORDER BY canonical_name) + (SELECT coalesce(max(id), 0) FROM topics) AS topic_id FROM (SELECT DISTINCT n.canonical_name FROM n LEFT JOIN known k ON k.canonical_name = n.canonical_name WHERE k.canonical_name IS NULL))
      SELECT span_id, topic_id, n.canonical_name, is_new FROM n JOIN (SELECT *, false AS is_new FROM known UNION ALL SELECT *, true FROM fresh) e ON e.canonical_name = n.canonical_name""",
    "topic_times": f"""WITH {SPANS}, s AS (SELECT topic_id, min(start_time) AS a, max(coalesce(end_time, start_time)) AS b FROM sp GROUP BY topic_id)
      SELECT t.id, coalesce(a, first_seen) AS first_seen, coalesce(b, last_seen) AS last_seen FROM topics t LEFT JOIN s ON s.topic_id = t.id""",
    "delete_forgotten": "WITH g AS (SELECT DISTINCT id FROM ideas WHERE forgotten) SELECT r.* FROM relations r LEFT JOIN g a ON a.id = r.from_id LEFT JOIN g b ON b.id = r.to_id WHERE a.id IS NULL AND b.id IS NULL",
    "clean_topic_name": f"SELECT id, {_clean('name')} AS clean, {_canonical('name')} AS canonical, length(lower(coalesce(name, ''))) < 5 OR regexp_matches(lower(coalesce(name, '')), '{_any(tx.BAD_NAMES)}') AS bad FROM topics",
}
