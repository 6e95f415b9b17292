"""Exact nearest vectors of a stated set of queries, in blocks against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, norm
from ..session import materialize, shared_dir

#: Queries of one pass: what is sent to all executors at once (32 MB at 64 numbers).
PASS = 65_536
#: Queries and rows whose scores a task holds at once (64 MB).
BLOCK, SLICE = 4096, 2048


def usable(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v): rows whose vector has dim numbers with a direction, as doubles."""
    v = doubles(F.col(vector))
    size = norm(v)
    return rows.where(F.col(key).isNotNull() & (F.size(vector) == dim) & (size > 0) & (size < float("inf"))).select(F.col(key).alias("id"), v.alias("v"))


def _in_passes(queries: DataFrame, rows: DataFrame, dim: int, make: Callable, schema: str, most: int = PASS, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """What make(ids, vectors, *more), a function for mapInArrow, finds in rows, for passes of about `most` queries by hash of
    their ids, and the number of passes. With more than one, each pass's result is written before the next pass's queries are
    read, so the driver and the executors hold one pass at a time."""
    spark = rows.sparkSession
    base = shared_dir(spark)
    kept, seen = materialize(queries.select("id", "v", *more), f"{base}/queries", n=F.count("*"))
    passes = -(-seen["n"] // most)
    if not passes:
        return spark.createDataFrame([], schema), 0

    def found(asked: DataFrame) -> DataFrame:
        block = asked.toArrow().combine_chunks().sort_by("id")
        names = block["id"].to_numpy()
        return rows.mapInArrow(make(names, block["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim), *[block[c].to_numpy() for c in more]), schema)

    if passes == 1:
        return found(kept), 1
    for k in range(passes):
        found(kept.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k)).write.parquet(f"{base}/pass={k}")
    return spark.read.schema(schema).parquet(f"{base}/pass=*"), passes


def _slices(batches: Iterator[pa.RecordBatch], dim: int, more: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids and vectors, and the next `more` columns, of at most SLICE rows each."""
    for b in batches:
        for s in range(0, b.num_rows, SLICE):
            part = b.slice(s, SLICE)
            yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, dim), *[part.column(2 + i).to_numpy() for i in range(more)]


def _scores(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What is smaller for nearer vectors, to nine places: minus the cosine, or the distance."""
    if metric == "cosine":
        unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
        return np.round(-(unit(a) @ unit(b).T), 9)
    if metric == "l2":
        return np.round(np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)), 9)
    raise ValueError(f"metric {metric!r}: cosine or l2")


def _best(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest of each row, ties by name."""
    if score.shape[1] > 4 * k:
        kth = np.partition(score, k - 1, axis=1)[:, k - 1]
        near = score <= kth[:, None]
        width = int(near.sum(1).max())
        short = np.argsort(~near, axis=1, kind="stable")[:, :width]
    else:
        short = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    s = np.take_along_axis(score, short, 1)
    order = np.lexsort((names[short], s), axis=1)[:, :k]
    return np.take_along_axis(short, order, 1)


def knn(queries: DataFrame, rows: DataFrame, k: int, dim: int = 64, metric: str = "cosine", with_self: bool = False, most: int = PASS, apart: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of each query, by score, then id; both inputs are (id, v).

    score is the cosine or the distance, to nine places. Without with_self a row isn't its query's neighbour under the
    same id. Each task keeps its k best of each query; only those are shuffled. Queries go out in passes of `most`.
    apart names a bigint column of both inputs, never null: a row with its query's value isn't the query's neighbour.
    """
    sign = -1.0 if metric == "cosine" else 1.0
    more = (apart,) if apart else ()

    def make(names: np.ndarray, vectors: np.ndarray, *groups: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list = [None] * -(-len(names) // BLOCK)
            for ids, v, *of in _slices(batches, dim, len(more)):
                for i in range(len(best)):
                    mine = names[i * BLOCK : (i + 1) * BLOCK]
                    score = _scores(metric, vectors[i * BLOCK : (i + 1) * BLOCK], v)
                    if not with_self:
                        score[mine[:, None] == ids[None]] = np.inf
                    for asked, there in zip(groups, of):
                        score[asked[i * BLOCK : (i + 1) * BLOCK, None] == there[None]] = np.inf
                    at = _best(score, ids, k)
                    near, who = np.take_along_axis(score, at, 1), ids[at]
                    if best[i] is not None:
                        score, both = np.hstack([best[i][0], near]), np.hstack([best[i][1], who])
                        order = np.lexsort((both, score), axis=1)[:, :k]
                        near, who = np.take_along_axis(score, order, 1), np.take_along_axis(both, order, 1)
                    best[i] = near, who
            for i, one in enumerate(best):
                if one is not None:
                    there = np.isfinite(one[0])
                    asked = np.repeat(names[i * BLOCK : (i + 1) * BLOCK], there.sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(one[1][there], pa.int64()), pa.array(one[0][there], pa.float64())], ["query_id", "id", "near"])

        return run

    out, _ = _in_passes(queries, rows.select("id", "v", *more), dim, make, "query_id bigint, id bigint, near double", most, more)
    w = Window.partitionBy("query_id").orderBy("near", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", (F.col("near") * sign).alias("score"))


def knn_apart(queries: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, dim: int = 64, spare: int = 20, apart: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of each query by cosine, then id, without the pairs (query_id, id).
    apart is as for knn.

    The search looks as many neighbours further as the query has pairs, so that k are left after they are taken out: `spare`
    further for most, the next power of two for queries with more pairs, in passes that are smaller as the lists are longer.
    """
    pairs = pairs.distinct()
    own = pairs.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > spare)
    # The length of n - 1 in binary digits is the exponent of the next power of two.
    many, seen = materialize(own.select(F.col("query_id").alias("id"), F.length(F.bin(F.col("n") - 1)).alias("digits")), f"{shared_dir(queries.sparkSession)}/many", n=F.count("*"))
    wide = knn(queries.join(many.select("id"), "id", "left_anti") if seen["n"] else queries, rows, k + spare, dim, apart=apart)
    for (digits,) in many.select("digits").distinct().orderBy("digits").collect() if seen["n"] else []:
        further = k + 2**digits
        asked = queries.join(many.where(F.col("digits") == digits).select("id"), "id", "left_semi")
        wide = wide.unionByName(knn(asked, rows, further, dim, most=max(1, PASS * (k + spare) // further), apart=apart))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    left = wide.drop("rank").join(pairs, ["query_id", "id"], "left_anti").withColumn("rank", F.row_number().over(w))
    return left.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def closest_points(rows: DataFrame, points: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """(id, rank, point_id, score): the k points of greatest cosine for each row, ties by point id; inputs are (id, v).

    Points go out in passes of PASS; with one pass nothing is shuffled.
    """

    def make(names: np.ndarray, vectors: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, v in _slices(batches, dim):
                near, who = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
                for i in range(0, len(names), BLOCK):
                    score = _scores("cosine", v, vectors[i : i + BLOCK])
                    at = _best(score, names[i : i + BLOCK], k)
                    near, who = np.hstack([near, np.take_along_axis(score, at, 1)]), np.hstack([who, names[i : i + BLOCK][at]])
                order = np.lexsort((who, near), axis=1)[:, :k]
                near, who = np.take_along_axis(near, order, 1), np.take_along_axis(who, order, 1)
                n = near.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.tile(np.arange(1, n + 1), len(ids)), pa.int32()), pa.array(who.ravel(), pa.int64()), pa.array(-near.ravel())], ["id", "rank", "point_id", "score"])

        return run

    out, passes = _in_passes(points, rows, dim, make, "id bigint, rank int, point_id bigint, score double")
    if passes <= 1:
        return out
    w = Window.partitionBy("id").orderBy(F.desc("score"), "point_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(queries: DataFrame, rows: DataFrame, least: float, dim: int = 64) -> DataFrame:
    """(query_id, id, score): all rows whose cosine with a query is at least this, without the query's own id. No shuffle."""

    def make(names: np.ndarray, vectors: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, v in _slices(batches, dim):
                for i in range(0, len(names), BLOCK):
                    mine = names[i : i + BLOCK]
                    score = -_scores("cosine", vectors[i : i + BLOCK], v)
                    q, r = np.nonzero((score >= least) & (mine[:, None] != ids[None]))
                    yield pa.RecordBatch.from_arrays([pa.array(mine[q], pa.int64()), pa.array(ids[r], pa.int64()), pa.array(score[q, r], pa.float64())], ["query_id", "id", "score"])

        return run

    return _in_passes(queries, rows, dim, make, "query_id bigint, id bigint, score double")[0]
