"""Parent-child rows to full hierarchies, by tree contraction.

Every round takes all leaves off (rake) and takes nodes with one child out of their chain where no neighbour goes in the
same round (compress). What goes is recorded with its parent of that moment and the stretch of path between the two. When
only circles are left, each shrunk to one node that is its own parent, the records are played back in reverse: a node's
root and path are its parent's, plus its stretch. The rounds grow with the logarithm of the number of nodes, however deep
the trees are; a parent of any number of children only ever counts in an aggregate that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_dir

RAKED, TAKEN, KEPT = "raked", "taken", "kept"


def hierarchy(rows: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, root_id, path, depth, loop_id): one row for each distinct node id.

    A node whose parent is null or no existing id is a root; path holds the ids from root to node, joined with ``/``, and
    depth counts the steps. If the chain of parents never ends, root_id is 0, path is empty, depth is null and loop_id the
    smallest id on the circle that the chain runs into; otherwise loop_id is 0. Of several rows of an id the smallest
    parent that isn't null counts. Rows without an id are no nodes. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    base = shared_dir(spark)
    found = _play(spark, *_contract(rows, node, parent, base), base)
    depth = F.when(F.col("loop_id") == 0, F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))))
    return found.select("id", "root_id", "path", depth.cast("int").alias("depth"), "loop_id")


def _play(spark: SparkSession, gone: list[DataFrame], active: DataFrame, base: str) -> DataFrame:
    """(id, root_id, path, loop_id): the records played back in reverse."""
    found = active.select("id", F.lit(0).cast("bigint").alias("root_id"), F.lit("").alias("path"), F.col("least").alias("loop_id"))
    found, _ = materialize(found, f"{base}/found/step={len(gone)}")
    for k in range(len(gone) - 1, -1, -1):
        taken = _attach(gone[k].where(F.col("what") == TAKEN), found)
        both = taken.unionByName(_attach(gone[k].where(F.col("what") == RAKED), found.unionByName(taken)))
        both.write.parquet(f"{base}/found/step={k}")
        found = spark.read.schema(found.schema).parquet(*[f"{base}/found/step={j}" for j in range(k, len(gone) + 1)])
    return found


def _contract(rows: DataFrame, node: str, parent: str, base: str, counts: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """The record of each round, and what is left: circles, each shrunk to one node. With counts the records have acc, the
    number of nodes that went into a node so far, and extra, the number that went between it and its parent."""
    ids = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("bigint").alias("id")).agg(F.min(F.col(parent).cast("bigint")).alias("parent"))
    known = ids.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("acc", "extra")] if counts else []
    active = ids.join(known, _under("up"), "left").select(
        "id", F.when(F.col("known"), F.col("parent")).alias("parent"), F.col("id").cast("string").alias("stretch"), F.col("id").alias("least"), *zeros
    )
    active, seen = materialize(active, f"{base}/nodes", left=F.count("*"))
    gone: list[DataFrame] = []
    while seen["left"]:
        done, seen = materialize(_round(active, len(gone), gone[-1] if gone else None, counts), f"{base}/round={len(gone)}", left=F.count_if((F.col("what") == KEPT) & ~F.col("id").eqNullSafe(F.col("next_parent"))))
        gone.append(done)
        more = ["acc", F.col("next_extra").alias("extra")] if counts else []
        active = done.where(F.col("what") == KEPT).select("id", F.col("next_parent").alias("parent"), F.col("next_stretch").alias("stretch"), F.col("next_least").alias("least"), *more)
    return gone, active


def _under(other: str) -> list:
    """That a row's parent is `other`. A row without parent has a key of its own, so that roots don't all meet in one task."""
    return [F.coalesce("parent", "id") == F.col(other), F.col("parent").isNotNull() == F.col(other).isNotNull()]


def _round(active: DataFrame, k: int, before: DataFrame | None, counts: bool) -> DataFrame:
    """active(id, parent, stretch, least) with what becomes of each node, and its parent and stretch thereafter.

    With counts, what was raked in the round before passes its number of nodes on to where it hung.
    """
    kids = active.where(F.col("parent").isNotNull()).select(F.col("parent").alias("id"), F.col("id").alias("kid"), *[F.lit(0).cast("bigint").alias("passed")] * counts)
    if counts and before is not None:
        kids = kids.unionByName(before.where((F.col("what") == RAKED) & F.col("next_parent").isNotNull()).select(F.col("next_parent").alias("id"), F.lit(None).cast("bigint").alias("kid"), "passed"))
    kids = kids.groupBy("id").agg(F.nullif(F.count("kid"), F.lit(0)).alias("kids"), F.min("kid").alias("kid"), *[F.sum("passed").alias("got")] * counts)
    nodes = active.join(kids, "id", "left")
    if counts:
        nodes = nodes.withColumn("acc", F.col("acc") + F.coalesce("got", F.lit(0)))
    luck = lambda c: F.xxhash64(F.col(c), F.lit(k))
    inner = (F.col("kids") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))
    taken = F.coalesce(inner & (luck("id") > luck("kid")) & (luck("id") > luck("parent")), F.lit(False))
    weight = F.col("acc") + F.col("extra") + 1
    out = nodes.where(taken).select(F.col("id").alias("out"), F.col("parent").alias("up"), F.col("stretch").alias("above"), F.col("least").alias("low"), *[weight.alias("between")] * counts)
    between = F.coalesce("between", F.lit(0))
    more = ["kid", "acc", "extra", (F.col("extra") + between).alias("next_extra"), (weight + between).alias("passed")] if counts else []
    return (
        nodes.withColumn("what", F.when(F.col("kids").isNull(), RAKED).when(taken, TAKEN).otherwise(KEPT))
        .join(out, _under("out"), "left")
        .select(
            "id",
            "parent",
            "stretch",
            "least",
            "what",
            F.coalesce("up", "parent").alias("next_parent"),
            F.when(F.col("up").isNotNull(), F.concat_ws("/", "above", "stretch")).otherwise(F.col("stretch")).alias("next_stretch"),
            F.least("least", "low").alias("next_least"),
            *more,
        )
    )


def _attach(nodes: DataFrame, found: DataFrame) -> DataFrame:
    above = found.select(F.col("id").alias("over"), F.col("root_id").alias("top"), F.col("path").alias("above"), F.col("loop_id").alias("loop"))
    looped = F.col("loop") > 0
    first = F.split_part(F.col("stretch"), F.lit("/"), F.lit(1)).cast("bigint")
    return nodes.join(above, _under("over"), "left").select(
        "id",
        F.coalesce("top", first).alias("root_id"),
        F.when(looped, "").otherwise(F.concat_ws("/", "above", "stretch")).alias("path"),
        F.coalesce("loop", F.lit(0)).cast("bigint").alias("loop_id"),
    )


def descendants(found: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): each node below each node, from the paths of hierarchy(). Nodes of circles have none."""
    ids = found.where(F.col("loop_id") == 0).select("id", F.posexplode(F.slice(F.split("path", "/"), 1, F.col("depth"))).alias("at", "ancestor"), "depth")
    return ids.select(F.col("ancestor").cast("bigint").alias("ancestor_id"), "id", (F.col("depth") - F.col("at")).alias("distance"))


def subtree_sizes(rows: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, below): the number of nodes below each node, 0 for leaves and for nodes of circles and what hangs below them.

    Numbers pass up as nodes are raked, and are kept beside the stretch of what is taken out, so no pair of a node and an
    ancestor is ever made. Played back in reverse, a node taken out has below it what went into it, its only child of that
    moment, what lay between them, and what is below that child.
    """
    spark = rows.sparkSession
    base = shared_dir(spark)
    gone, active = _contract(rows, node, parent, base, counts=True)
    found = active.select("id", F.lit(0).cast("bigint").alias("below"))
    found, circles = materialize(found, f"{base}/below/step={len(gone)}", n=F.count("*"))
    for k in range(len(gone) - 1, -1, -1):
        raked = gone[k].where(F.col("what") == RAKED).select("id", F.col("acc").alias("below"))
        gaps = gone[k].select(F.col("id").alias("kid"), F.col("extra").alias("gap"))
        kids = found.unionByName(raked).select(F.col("id").alias("kid"), F.col("below").alias("deeper"))
        taken = gone[k].where(F.col("what") == TAKEN).select("id", "acc", "kid").join(gaps, "kid").join(kids, "kid")
        both = raked.unionByName(taken.select("id", (F.col("acc") + F.col("gap") + F.col("deeper") + 1).alias("below")))
        both.write.parquet(f"{base}/below/step={k}")
        found = spark.read.schema(found.schema).parquet(*[f"{base}/below/step={j}" for j in range(k, len(gone) + 1)])
    if not circles["n"]:
        return found
    looped = _play(spark, gone, active, base).where("loop_id > 0").select("id", F.lit(True).alias("looped"))
    return found.join(looped, "id", "left").select("id", F.when(F.col("looped"), 0).otherwise(F.col("below")).alias("below"))
