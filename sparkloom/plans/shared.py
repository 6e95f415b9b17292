"""SQL fragments that several queries' statements share."""

QUERIES: dict = {}
SQL: dict = {}

_LAST = ", ".join(f"{c} DESC NULLS LAST" for c in ("end_time", "end_line", "depth", "topic_id", "start_time", "created_at", "start_line", "name", "summary", "session", "parent_id"))
#: One row for each span.
SPANS = f"sp AS (SELECT * FROM spans WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_LAST}) = 1)"
SEEN = "coalesce(message_time, created_at)"
VISIBLE = "NOT coalesce(forgotten, false)"
#: Visible ideas with their span's topic.
TOPICAL = f"ti AS (SELECT i.*, sp.topic_id FROM ideas i LEFT JOIN sp ON sp.id = i.span_id WHERE {VISIBLE})"
#: Usable idea vectors as doubles.
VECTORS = "vec AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM ideas WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)"
#: Topics' mean vectors.
CENTROIDS = f"""{SPANS}, {TOPICAL},
members AS (SELECT ti.id, ti.topic_id, list_transform(vec.v, lambda x: x / sqrt(list_sum(list_transform(vec.v, lambda y: y * y)))) AS v FROM ti JOIN vec ON vec.id = ti.id WHERE topic_id IS NOT NULL),
places AS (SELECT topic_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM members),
means AS (SELECT topic_id, p, round(avg(x), 9) AS x FROM places GROUP BY topic_id, p),
raw AS (SELECT topic_id, list(x ORDER BY p) AS v FROM means GROUP BY topic_id),
centres AS (SELECT topic_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM raw)"""
WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def week(c: str) -> str:
    return f"printf('%04d-W%02d', year({c}), weekofyear({c}))"


PERIODS = {"day": lambda c: f"strftime({c}, '%Y-%m-%d')", "week": week, "month": lambda c: f"strftime({c}, '%Y-%m')"}
