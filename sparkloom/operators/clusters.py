"""Topics as clusters of idea vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm, unit
from ..session import materialize, shared_dir
from .memory import visible, with_topic
from .nearest import closest_points, usable, within

#: Centres of clusters up to this many are broadcast (41 MB at 64 numbers).
BROADCAST_CENTRES = 80_000


def topic_ideas(ideas: DataFrame, span_rows: DataFrame, dim: int = 64) -> DataFrame:
    """(id, topic_id, v): visible ideas with a topic and a usable vector, brought to length 1."""
    rows = with_topic(visible(ideas), span_rows).where(F.col("topic_id").isNotNull())
    return usable(rows, "id", "embedding", dim).join(rows.select("id", "topic_id"), "id").select("id", "topic_id", unit(F.col("v")).alias("v"))


def centroids(rows: DataFrame, by: str, dim: int = 64) -> DataFrame:
    """(by, size, v): mean vector of each group to nine places, at length 1. One average for each place, combined before the
    shuffle, so large groups are no hot keys. The few rows are written once, as those who use them read them several times."""
    means = rows.groupBy(by).agg(F.count("*").alias("size"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)])
    v = F.transform(F.array(*[F.col(f"m{i}") for i in range(dim)]), lambda x: F.round(x, 9))
    found = means.select(by, "size", v.alias("v")).where(norm(F.col("v")) > 0).select(by, "size", unit(F.col("v")).alias("v"))
    return materialize(found, f"{shared_dir(rows.sparkSession)}/centroids")[0]


def coherence(rows: DataFrame, centres: DataFrame, by: str) -> DataFrame:
    """(by, size, mean_distance, max_distance, score): cosine distances of the members from their centre, four places."""
    c = centres.select(by, F.col("v").alias("centre"))
    d = 1 - cosine(F.col("v"), F.col("centre"))
    stats = rows.join(c, by).select(by, d.alias("d")).groupBy(by).agg(F.count("*").alias("size"), F.avg("d").alias("m"), F.max("d").alias("x"))
    return stats.select(by, "size", F.round("m", 4).alias("mean_distance"), F.round("x", 4).alias("max_distance"), F.round(1 - F.col("m"), 3).alias("score"))


def split_candidates(scores: DataFrame, least: int = 5, below: float = 0.7) -> DataFrame:
    return scores.where((F.col("size") >= least) & (F.col("score") < below))


def merge_candidates(centres: DataFrame, by: str, above: float = 0.85, dim: int = 64) -> DataFrame:
    """(a, b, similarity), a < b: groups whose centres are at least as near as a cosine."""
    points = centres.select(F.col(by).alias("id"), "v")
    near = within(points, points, above, dim).where(F.col("query_id") < F.col("id"))
    return near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("similarity"))


def misplaced(rows: DataFrame, centres: DataFrame, dim: int = 64, ratio: float = 0.8) -> DataFrame:
    """(id, topic_id, better_id, own, other, improvement): ideas whose distance to another topic's centre is below ratio times
    that to their own; improvement in percent, one place."""
    points = centres.select(F.col("topic_id").alias("id"), "v")
    two = closest_points(rows.select("id", "v"), points, 2, dim)
    own = rows.join(centres.select("topic_id", F.col("v").alias("centre")), "topic_id").select("id", "topic_id", F.round(1 - cosine(F.col("v"), F.col("centre")), 9).alias("own"))
    other = two.join(own.select("id", "topic_id"), "id").where(F.col("point_id") != F.col("topic_id"))
    best = other.groupBy("id").agg(F.min(F.struct(F.round(1 - F.col("score"), 9).alias("d"), "point_id")).alias("b"))
    found = own.join(best, "id").where(F.col("b.d") < ratio * F.col("own"))
    return found.select("id", "topic_id", F.col("b.point_id").alias("better_id"), F.round("own", 6).alias("own"), F.round(F.col("b.d"), 6).alias("other"), F.round(100 * (F.col("own") - F.col("b.d")) / F.col("own"), 1).alias("improvement"))


def kmeans(rows: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """(id, cluster): clusters of (id, v); k is the root of the number of rows, 2 to 8, if not given. Fewer than four rows are
    one cluster. Labels depend on Spark's initialisation, so hold them against inertia, not against labels."""
    n = rows.count()
    if n < 4:
        return rows.select("id", F.lit(0).alias("cluster"))
    k = k or max(2, min(8, int(n**0.5)))
    points = rows.select("id", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(points).transform(points).select("id", F.col("prediction").alias("cluster"))


def subclusters(rows: DataFrame, k: int | None = None, rounds: int = 20, dim: int = 64) -> DataFrame:
    """(id, topic_id, cluster, distance): k-means within each topic of topic_ideas(), all topics at once.

    k is the root of the topic's number of ideas, 2 to 8, if not given; topics of fewer than four ideas are left out. A topic
    starts from the ideas with the smallest hashes of their ids. A round is one aggregate of partial sums, so a topic may hold any share of
    the ideas; a cluster that loses all its ideas keeps its centre. It ends when no centre moves, after `rounds` at most.
    distance is the squared one to the cluster's centre, to nine places; ties go to the smaller cluster. Up to
    BROADCAST_CENTRES centres are broadcast, more are joined by shuffle.
    """
    base = shared_dir(rows.sparkSession)
    sizes = rows.groupBy("topic_id").agg(F.count("*").alias("n")).where("n >= 4")
    wanted = F.lit(k) if k else F.greatest(F.lit(2), F.least(F.lit(8), F.floor(F.sqrt("n")).cast("int")))
    points, _ = materialize(rows.join(sizes, "topic_id").select("id", "topic_id", "v", wanted.alias("k")), f"{base}/points")
    w = Window.partitionBy("topic_id").orderBy(F.xxhash64("id"), "id")
    first = points.withColumn("c", F.row_number().over(w)).where(F.col("c") <= F.least(F.lit(k or 8), "k"))
    centres, seen = materialize(first.select("topic_id", (F.col("c") - 1).alias("c"), "v"), f"{base}/start", n=F.count("*"))
    hint = F.broadcast if seen["n"] <= BROADCAST_CENTRES else (lambda df: df)

    def met(centres: DataFrame) -> DataFrame:
        every = centres.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("cs"))
        return points.join(hint(every), "topic_id").select("id", "topic_id", "v", "cs")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, c, _ = _closest(b, dim)
            groups, at = np.unique(np.stack([b["topic_id"].to_numpy(), c]), axis=1, return_inverse=True)
            total = np.zeros((groups.shape[1], dim))
            np.add.at(total, at.ravel(), v)
            ends = pa.array(np.arange(0, total.size + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(groups[0]), pa.array(groups[1].astype(np.int32)), pa.array(np.bincount(at.ravel())), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], ["topic_id", "c", "n", "s"])

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, c, d = _closest(b, dim)
            yield pa.RecordBatch.from_arrays([b["id"], b["topic_id"], pa.array(c.astype(np.int32)), pa.array(d)], ["id", "topic_id", "cluster", "distance"])

    for i in range(rounds - 1):
        parts = met(centres).mapInArrow(sums, "topic_id bigint, c int, n bigint, s array<double>")
        whole = parts.groupBy("topic_id", "c").agg(*[F.round(F.sum(F.col("s")[j]) / F.sum("n"), 9).alias(f"m{j}") for j in range(dim)])
        fresh = whole.select("topic_id", "c", F.array(*[F.col(f"m{j}") for j in range(dim)]).alias("new"))
        moved = centres.join(fresh, ["topic_id", "c"], "left").select("topic_id", "c", F.coalesce("new", "v").alias("v"), F.coalesce(F.col("new") != F.col("v"), F.lit(False)).alias("moves"))
        centres, seen = materialize(moved, f"{base}/round{i}", moves=F.count_if("moves"))
        centres = centres.drop("moves")
        if not seen["moves"]:
            break
    return met(centres).mapInArrow(labels, "id bigint, topic_id bigint, cluster int, distance double")


def _closest(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a batch (v, cs), the nearest of each one's own centres, and the squared distance to it, to nine places."""
    v = batch["v"].flatten().to_numpy().reshape(-1, dim)
    if not len(v):
        return v, np.empty(0, np.int64), np.empty(0)
    cs = batch["cs"]
    number, centre = cs.flatten().flatten()
    counts = cs.value_lengths().to_numpy()
    row, start = np.repeat(np.arange(len(v)), counts), np.cumsum(counts) - counts
    d = np.round(((v[row] - centre.flatten().to_numpy().reshape(-1, dim)) ** 2).sum(1), 9)
    least = np.minimum.reduceat(d, start)
    # Centres are in the order of their numbers, so the first of equal ones is the smallest.
    _, first = np.unique(row[d == least[row]], return_index=True)
    return v, number.to_numpy()[d == least[row]][first].astype(np.int64), least


def split(found: DataFrame, least: int = 3) -> DataFrame:
    """(topic_id, cluster, size, inertia, first_id, child): the clusters of subclusters(): how many ideas, the sum of their squared distances, the
    idea nearest to the centre, and whether the cluster is large enough to become a topic below its own."""
    one = found.groupBy("topic_id", "cluster").agg(F.count("*").alias("size"), F.round(F.sum("distance"), 6).alias("inertia"), F.min(F.struct("distance", "id")).alias("first"))
    return one.select("topic_id", "cluster", "size", "inertia", F.col("first.id").alias("first_id"), (F.col("size") >= least).alias("child"))


def cluster_report(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(topic_id, size, score, misplaced, partners, may_split) of each topic of topic_ideas(): how close it is, how many of its
    ideas are nearer to another topic, how many topics it may merge with, and whether it may be split."""
    centres = centroids(rows, "topic_id", dim)
    close = coherence(rows, centres, "topic_id").select("topic_id", "size", "score")
    astray = misplaced(rows, centres, dim).groupBy("topic_id").agg(F.count("*").alias("misplaced"))
    pairs = merge_candidates(centres, "topic_id", dim=dim)
    partners = pairs.select(F.col("a").alias("topic_id")).unionByName(pairs.select(F.col("b").alias("topic_id"))).groupBy("topic_id").agg(F.count("*").alias("partners"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = close.join(astray, "topic_id", "left").join(partners, "topic_id", "left")
    return joined.select("topic_id", "size", "score", zero("misplaced"), zero("partners"), ((F.col("size") >= 5) & (F.col("score") < 0.7)).alias("may_split"))
