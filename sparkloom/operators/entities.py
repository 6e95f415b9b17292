"""Names of things to their main entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import string_similarity


def find_golden(names: DataFrame, golden: DataFrame, least: float = 0.8) -> DataFrame:
    """(name, golden_id, canonical_name, similarity) of each different name: the entry of the same name in any case, else the
    most similar one (2 * longest common subsequence / lengths) of at least `least`, ties by id.

    Names only meet entries whose length lets them reach `least`; each different name is compared once.
    """
    n = names.where(F.length("name") > 0).select("name", F.lower("name").alias("low")).distinct()
    g = golden.where(F.length("canonical_name") > 0).select(F.col("id").alias("golden_id"), "canonical_name", F.lower("canonical_name").alias("known"))
    exact = n.join(g, F.col("low") == F.col("known")).groupBy("name").agg(F.min(F.struct("golden_id", "canonical_name")).alias("g")).select("name", "g.*", F.lit(1.0).alias("similarity"))
    rest = n.join(exact.select("name"), "name", "left_anti")
    ratio = least / (2 - least)
    size = F.char_length("low")
    reach = rest.select("name", "low", F.explode(F.sequence(F.ceil(size * ratio).cast("int"), F.floor(size / ratio).cast("int"))).alias("size"))
    near = reach.join(g.withColumn("size", F.char_length("known")), "size").withColumn("similarity", string_similarity(F.col("low"), F.col("known"))).where(F.col("similarity") >= least)
    best = near.groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "golden_id", "canonical_name")).alias("b"))
    return exact.unionByName(best.select("name", "b.golden_id", "b.canonical_name", (-F.col("b.s")).alias("similarity")))


def similar_pairs(names: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity): the pairs a < b of (id, name) whose names are at least this similar, to six places.

    Names only meet names whose length lets them reach `least`, and are compared in order only where the letters they share,
    in any order, let them reach it too.
    """
    low = F.lower("name")
    # Each letter with its number among its like, so that what two names share can be counted as a set.
    letters = F.filter(F.split(low, ""), lambda c: c != "")
    bag = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).cast("string")))
    rows = names.where(F.length("name") > 0).select("id", "name", F.char_length(low).alias("size"), bag.alias("bag"))
    ratio, size, slack = least / (2 - least), F.col("size"), 1e-6
    reach = F.explode(F.sequence(F.ceil(size * ratio - slack).cast("int"), F.floor(size / ratio + slack).cast("int")))
    a = rows.select(F.col("id").alias("a"), F.col("name").alias("x"), F.col("size").alias("m"), F.col("bag").alias("p"), reach.alias("size"))
    b = rows.select(F.col("id").alias("b"), F.col("name").alias("y"), "size", F.col("bag").alias("q"))
    shared = F.size(F.array_intersect("p", "q"))
    met = a.join(b, "size").where((F.col("a") < F.col("b")) & (2 * shared >= (least - slack) * (F.col("m") + size)))
    return met.select("a", "b", F.round(string_similarity(F.col("x"), F.col("y")), 6).alias("similarity")).where(F.col("similarity") >= least)


def link_mentions(mentions: DataFrame, golden: DataFrame, least: float = 0.8) -> DataFrame:
    """mentions with golden_id, null where no entry fits."""
    found = find_golden(mentions, golden, least).select("name", F.col("golden_id").alias("_golden"))
    return mentions.drop("golden_id").join(found, "name", "left").withColumnRenamed("_golden", "golden_id")


def search_entities(names: DataFrame, golden: DataFrame, mentions: DataFrame, kind: str | None = None) -> DataFrame:
    """(name, golden_id, canonical_name, type, similarity, mention_count) of each different name: the entries of exactly this
    name, else the one that find_golden() gives, without those of another type than `kind`.

    golden is (id, canonical_name, type), mentions is (golden_id). Mentions are counted before they are joined.
    """
    asked = names.where(F.length("name") > 0).select("name").distinct()
    entries = golden.select(F.col("id").alias("golden_id"), "canonical_name", "type")
    exact = asked.join(entries.select("golden_id", "canonical_name"), F.col("name") == F.col("canonical_name")).select("name", "golden_id", F.lit(1.0).alias("similarity"))
    near = find_golden(asked.join(exact.select("name"), "name", "left_anti"), golden).select("name", "golden_id", "similarity")
    counts = mentions.where(F.col("golden_id").isNotNull()).groupBy("golden_id").agg(F.count("*").alias("mention_count"))
    found = exact.unionByName(near).join(entries, "golden_id").join(counts, "golden_id", "left")
    fits = F.lit(True) if kind is None else F.col("type") == kind
    return found.where(fits).select("name", "golden_id", "canonical_name", "type", "similarity", F.coalesce("mention_count", F.lit(0)).alias("mention_count"))
