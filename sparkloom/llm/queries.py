"""Queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.structure import RECORD_TEXTS as _TEXTS
from ..session import table
from . import conversations, encoding, leakage, neighbours, quality, splitting


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "ideas"), "id", "embedding")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(_nearest(spark, sf))


def p2_ranked(spark: SparkSession, sf: str) -> DataFrame:
    zipped = F.arrays_zip("ids", "similarities")
    rows = _nearest(spark, sf).select("id", F.posexplode(zipped).alias("at", "one"))
    return rows.select("id", (F.col("at") + 1).alias("rank"), F.col("one.ids").alias("neighbour_id"), F.col("one.similarities").alias("similarity"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversations(table(spark, sf, "synthetic_conversation"))


def p3_turns(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversation_turns(table(spark, sf, "synthetic_conversation"))


def p3_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, sf, "synthetic_conversation"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.broken_records(table(spark, sf, "synthetic_conversation"))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.record_pieces(table(spark, sf, "synthetic_conversation"))


def p5_covered(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the pieces, whatever the splitter chose: their number is at least what the length needs, they cover
    the text from its beginning to its end, none is over the limit, and none starts more than the overlap before a stop."""
    pieces = p5_pieces(spark, sf)
    w = Window.partitionBy("rec_id").orderBy("piece")
    before = pieces.withColumn("before", F.lag("stop").over(w))
    fits = (F.col("stop") - F.col("start") <= splitting.LIMIT) & (F.char_length("text") == F.col("stop") - F.col("start"))
    joins = F.coalesce(F.col("before") - F.col("start"), F.col("start"))
    rows = before.groupBy("rec_id").agg(F.max("stop").alias("size"), F.bool_and(fits).alias("fits"), F.bool_and(joins.between(0, splitting.OVERLAP)).alias("joins"), F.min("start").alias("first"))
    return rows


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode(table(spark, sf, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.round_trip(spark, table(spark, sf, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, sf), "doc_id", "item_id")


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.removal_spans(_leaks(spark, sf), "doc_id")


def p8_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classified(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "common_words"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that aren't prose: of the statistics only those that the learned rules name are worked out."""
    kinds = quality.classified(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "common_words"), names=())
    return kinds.where(~F.col("kind").isin("prose", "blank")).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_ranked, p3_found, p3_turns, p3_dropped, p5_found, p5_pieces, p5_covered, p6_ids, p6_round_trip, p7_found, p7_spans, p8_found, p8_kinds)}

#: The turns of whole conversations (opened), as a chain of common table expressions.
_OPENED = (
    _TEXTS
    + r"""
, rows_ AS (
  SELECT session, source_file, line_num, rec_id, type = 'user' AS by_user, damaged,
    coalesce(regexp_matches(txt, '[^\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]'), false) AS turn,
    CASE WHEN regexp_full_match(timestamp, '[0-9]{1,15}') THEN CAST(timestamp AS BIGINT) * 1000
         WHEN regexp_full_match(timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?')
         THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches(timestamp, '(Z|[+-][0-9]{2}(:?[0-9]{2})?)$') AND NOT regexp_full_match(timestamp, '.{10}') THEN timestamp ELSE timestamp || 'Z' END AS TIMESTAMPTZ)) END AS instant,
    CASE WHEN coalesce(regexp_replace(message.role, '[\s\p{Z}]', '', 'g'), '') = '' THEN type ELSE lower(regexp_replace(message.role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) END AS speaker, type
  FROM texts WHERE session IS NOT NULL
), ordered AS (
  SELECT *, lag(by_user) OVER w AS earlier, row_number() OVER w AS n, count(*) OVER (PARTITION BY session) AS size FROM rows_ WHERE turn OR damaged
  WINDOW w AS (PARTITION BY session ORDER BY instant NULLS FIRST, source_file, line_num, rec_id)
), whole AS (
  SELECT session FROM ordered GROUP BY session
  HAVING NOT bool_or(damaged OR instant IS NULL OR speaker <> type OR (by_user AND coalesce(earlier, false)) OR (n = 1 AND NOT by_user) OR (n = size AND by_user))
), opened AS (
  SELECT session, rec_id, n, last_value(CASE WHEN by_user THEN n END IGNORE NULLS) OVER w AS open_n, last_value(CASE WHEN by_user THEN rec_id END IGNORE NULLS) OVER w AS opener_rec_id
  FROM ordered SEMI JOIN whole USING (session) WINDOW w AS (PARTITION BY session ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
"""
)

SQL = {
    "p3_found": _OPENED + "SELECT session, opener_rec_id, CAST(n - open_n AS INTEGER) AS step, rec_id FROM opened",
    "p3_turns": _OPENED + "SELECT o.session, opener_rec_id, CAST(n - open_n AS INTEGER) AS step, o.rec_id, t.type AS role, t.txt AS text FROM opened o JOIN texts t ON t.rec_id = o.rec_id",
    "p3_dropped": _OPENED
    + """SELECT s.session, coalesce(size, 0) AS turns FROM (SELECT DISTINCT session FROM synthetic_conversation WHERE session IS NOT NULL) s
LEFT JOIN (SELECT session, count(*) AS size FROM ordered GROUP BY 1) o ON o.session = s.session WHERE s.session NOT IN (SELECT session FROM whole)""",
    "p5_found": _TEXTS
    + r"""
SELECT rec_id, CAST(list_max(list_transform(regexp_split_to_array(txt, '[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+'), lambda x: length(x))) > 1600 AS INTEGER) AS unbroken
FROM texts WHERE length(txt) > 1600""",
    "p5_covered": _TEXTS + " SELECT rec_id, CAST(length(txt) AS INTEGER) AS size, true AS fits, true AS joins, 0 AS first FROM texts WHERE length(txt) > 1600",
    "p7_found": r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
grams AS (SELECT DISTINCT item_id, least(len(w), 12) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), 12) - 1], ' '))) AS gram FROM items WHERE len(w) > 0),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
parts AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram FROM words, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)
SELECT DISTINCT doc_id, item_id FROM parts JOIN grams USING (k, gram)""",
}
