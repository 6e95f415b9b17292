"""Export of a memory to JSON lines, and import with new ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import spans
from ..operators.ordering import numbered

VERSION = 1
TABLES = ("spans", "ideas", "relations")


def part_of(tables: dict[str, DataFrame], session: str | None = None) -> dict[str, DataFrame]:
    """The spans and ideas of a session (all if None), and the relations that touch them."""
    if session is None:
        return {t: tables[t] for t in TABLES}
    ideas = tables["ideas"].where(F.col("session") == session)
    ids = ideas.select("id")
    out = tables["relations"].join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    back = tables["relations"].join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    relations = out.unionByName(back).dropDuplicates(["id"])
    return {"spans": tables["spans"].where(F.col("session") == session), "ideas": ideas, "relations": relations.select(tables["relations"].columns)}


def export(tables: dict[str, DataFrame], path: str, session: str | None = None) -> None:
    """Writes each table of the part as JSON lines under path, in parallel, with the version in the folder's name."""
    for name, df in part_of(tables, session).items():
        df.write.mode("overwrite").json(f"{path}/v{VERSION}/{name}")


def load(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables of an export of this version."""
    return {name: spark.read.schema(schemas[name]).json(f"{path}/v{VERSION}/{name}") for name in TABLES}


def import_into(own: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """own with new added under fresh ids after own's last ones.

    Ideas without a known span, or whose place in a transcript own already has, are left out, as are relations that lose an
    end. Parents that aren't in the import become null.
    """
    zero = F.lit(0)

    def renamed(df: DataFrame, of: DataFrame) -> DataFrame:
        top = of.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        ids = numbered(df.select("id").distinct().withColumn("all", zero), ["all"], ["id"])
        return ids.crossJoin(F.broadcast(top)).select("id", (F.col("top") + F.col("place")).alias("new_id"))

    s = spans(new["spans"])
    span_ids = renamed(s, own["spans"])
    parents = span_ids.select(F.col("id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    s = s.join(span_ids, "id").join(parents, "parent_id", "left").withColumn("id", F.col("new_id")).withColumn("parent_id", F.col("new_parent")).select(own["spans"].columns)
    places = own["ideas"].select("source_file", "source_line")
    i = new["ideas"].join(places, ["source_file", "source_line"], "left_anti")
    i = i.join(span_ids.select(F.col("id").alias("span_id"), F.col("new_id").alias("new_span")), "span_id")
    idea_ids = renamed(i, own["ideas"])
    i = i.join(idea_ids, "id").withColumn("id", F.col("new_id")).withColumn("span_id", F.col("new_span")).select(own["ideas"].columns)
    r = new["relations"]
    for end in ("from_id", "to_id"):
        r = r.join(idea_ids.select(F.col("id").alias(end), F.col("new_id").alias(f"new_{end}")), end)
    relation_ids = renamed(r, own["relations"])
    r = r.join(relation_ids, "id").withColumn("id", F.col("new_id")).withColumn("from_id", F.col("new_from_id")).withColumn("to_id", F.col("new_to_id")).select(own["relations"].columns)
    return own | {"spans": own["spans"].unionByName(s), "ideas": own["ideas"].unionByName(i), "relations": own["relations"].unionByName(r)}
