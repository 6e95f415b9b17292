"""Queries on nested records and on hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import hierarchy, shredding
from ..session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return shredding.content_objects(table(spark, sf, "synthetic_conversation"))


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    return shredding.content_values(table(spark, sf, "synthetic_conversation"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf, "spans")).select("id", "root_id", "path", "loop_id")


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, sf, "spans")))


def p4_below(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.subtree_sizes(table(spark, sf, "spans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p4_found, p4_descendants, p4_below)}

_CHAINS = """
WITH RECURSIVE nodes AS (SELECT id, min(parent_id) AS parent FROM spans WHERE id IS NOT NULL GROUP BY id),
linked AS (SELECT n.id, p.id AS parent FROM nodes n LEFT JOIN nodes p ON n.parent = p.id),
walk AS (
  SELECT id, parent AS up, [id] AS chain FROM linked
  UNION ALL
  SELECT w.id, l.parent, list_append(w.chain, w.up) FROM walk w JOIN linked l ON l.id = w.up WHERE NOT list_contains(w.chain, w.up)
),
ends AS (SELECT id, arg_max(chain, len(chain)) AS chain, arg_max(up, len(chain)) AS up FROM walk WHERE up IS NULL OR list_contains(chain, up) GROUP BY id),
found AS (
  SELECT id, chain, up IS NOT NULL AS looped,
         CASE WHEN up IS NULL THEN 0 ELSE list_min(chain[list_position(chain, up):]) END AS loop_id FROM ends
)
"""

#: Standing records of speakers, with their text (txt), as a chain of common table expressions.
RECORD_TEXTS = r"""
WITH stood AS (
  SELECT *, message.content AS c FROM synthetic_conversation
  QUALIFY source_file IS NULL OR line_num IS NULL OR row_number() OVER (PARTITION BY source_file, line_num ORDER BY rec_id) = 1
), said AS (
  SELECT *, c[:2] = '[{' OR c = '[]' AS is_list FROM stood WHERE type IN ('user', 'assistant') AND tool_use_result IS NULL AND c IS NOT NULL
), parsed AS (
  SELECT *, is_list AND NOT json_valid(c) AS damaged,
    CASE WHEN is_list AND json_valid(c) THEN
      list_filter(CAST(json_extract(c, '$[*]') AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'text' AND json_type(b, '$.text') = 'VARCHAR') END AS blocks
  FROM said
), texts AS (
  SELECT *, CASE WHEN is_list THEN CASE WHEN len(blocks) > 0 THEN array_to_string(list_transform(blocks, lambda b: json_extract_string(b, '$.text')), chr(10)) END ELSE c END AS txt,
    len(list_filter(CAST(CASE WHEN is_list AND json_valid(c) THEN json_extract(c, '$[*]') END AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'tool_use')) > 0 AS uses_tool
  FROM parsed
)
"""

SQL = {
    "p4_found": _CHAINS
    + """SELECT id, CASE WHEN looped THEN 0 ELSE chain[-1] END AS root_id,
      CASE WHEN looped THEN '' ELSE array_to_string(list_reverse(chain), '/') END AS path, CAST(loop_id AS BIGINT) AS loop_id FROM found""",
    "p4_descendants": _CHAINS
    + """SELECT ancestor_id, id, CAST(distance AS INTEGER) AS distance
      FROM (SELECT id, unnest(chain[2:]) AS ancestor_id, generate_subscripts(chain[2:], 1) AS distance FROM found WHERE NOT looped)""",
    "p4_below": _CHAINS
    + """, pairs AS (SELECT unnest(chain[2:]) AS a FROM found WHERE NOT looped)
      SELECT f.id, CAST(count(p.a) AS BIGINT) AS below FROM found f LEFT JOIN pairs p ON p.a = f.id GROUP BY f.id""",
}
