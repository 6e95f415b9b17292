"""The k most similar vectors of every vector, by multi-index hashing.

A learned rotation (principal axes, turned by iterative quantisation on a bounded sample) gives every vector a binary code,
which is split into TABLES substrings, each the key of an index. Codes within a Hamming radius of TABLES - 1 agree in at
least one substring (pigeonhole), so probing each vector's own keys retrieves all of them. The floats of everything
retrieved are reranked: single precision rules out what its rounding error can't bring among the k best, double precision
orders the rest, however many near-copies that leaves. Substrings lengthen with the logarithm of the number of vectors, so
that a bucket holds about BUCKET of them at any size of the collection.

No bucket is dropped or cut. One beyond MAX_BUCKET is worked in tiles of its rows against its rows. Of exact copies of one
vector only the k + 1 smallest ids can be anyone's neighbours: further ones stay out of the index and get those ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_dir

TABLES, BUCKET, MAX_BUCKET = 4, 1536, 8192
#: At most so many vectors, chosen by a hash of their ids, fit the rotation. All vectors are indexed.
SAMPLE = 20_000
#: Most bits of a substring: buckets of BUCKET up to some 10^15 vectors.
KEY_BITS = 40
#: A list of oversized buckets up to this length is broadcast (16 bytes a row), a longer one joined by shuffle.
BROADCAST_ROWS = 100_000
#: Pairs reranked at once (32 MB a copy at 64 numbers); one query's pairs in a bucket or tile stay together.
PAIRS, NOBODY = 65_536, np.iinfo(np.int64).min


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v): rows with an id whose vector has dim finite numbers, not all zero."""
    v = F.col(vector)
    # The sum of the absolute values is null, NaN or infinite if a number is, and 0 if all are.
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    fine = F.col(key).isNotNull() & (F.size(v) == dim) & (size > 0) & (size < float("inf"))
    return vectors.where(fine).select(F.col(key).cast("bigint").alias("id"), v.cast("array<float>").alias("v"))


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection whose signs are the code, from unit vectors."""
    centre = sample.mean(0)
    axes = np.linalg.eigh(np.cov((sample - centre).T) if len(sample) > 1 else np.eye(sample.shape[1]))[1][:, ::-1][:, :bits]
    z = (sample - centre) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ v).T
    return centre, axes @ turn


def learn_code(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As learn_rotation, for any number of bits: beyond one for each dimension, further rotations give the rest."""
    each = sample.shape[1]
    parts = [learn_rotation(sample, min(each, bits - at), seed=at // each) for at in range(0, bits, each)]
    return parts[0][0], np.hstack([turn for _, turn in parts])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, key: str, vector: str, k: int = 10, dim: int = 64, tables: int = TABLES, bucket: int = BUCKET, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(id, ids, similarities): up to k most similar other vectors of each usable one, best first.

    Similarity is the cosine; equal values go by the smaller id. Null vectors, those of another length, all zero or with
    numbers that aren't finite have no row and are nobody's neighbour. Keys are unique; equal vectors under different keys
    are neighbours. Fewer than k + 1 usable vectors give shorter lists. On the test data recall is about 0.98.
    """
    spark = vectors.sparkSession
    base = shared_dir(spark)
    good = usable(vectors, key, vector, dim)
    rows = vectors.count()
    share = 1_000_000 if rows <= SAMPLE else 900_000 * SAMPLE // rows + 1
    # Thinned before it is ordered, so that tasks don't each send a whole sample.
    sample = good.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "id bigint, ids array<bigint>, similarities array<float>")
    width = min(KEY_BITS, max(0, round(float(np.log2(max(1, rows) / bucket)))))
    tables = tables if width else 1
    x = _matrix(sample["v"].combine_chunks(), dim).astype(np.float64)
    centre, turn = learn_code(x / np.linalg.norm(x, axis=1)[:, None], tables * width) if width else (np.zeros(dim), np.zeros((dim, 0)))

    copies, extra = _copies(good, k, base)
    if copies is not None:
        good = good.join(copies.select("id"), "id", "left_anti")

    def keys(v: np.ndarray) -> np.ndarray:
        unit = v / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
        bits = ((unit - centre) @ turn > 0).reshape(len(v), tables, width)
        return (bits << np.arange(width)).sum(2) + (np.arange(tables) << 40)

    def count(batches):
        for b in batches:
            found, n = np.unique(keys(_matrix(b.column(1), dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])

    def place(batches):
        for b in batches:
            v = np.ascontiguousarray(_matrix(b.column(1), dim), np.float32)
            at = np.repeat(np.arange(len(v)), tables)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(v), [None, pa.py_buffer(v)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys(v).ravel(), pa.int64()), b.column(0).take(pa.array(at)), raw.take(pa.array(at))], ["bucket", "id", "v"])

    placed = good.mapInArrow(place, "bucket bigint, id bigint, v binary")
    sizes = good.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    large, seen = materialize(sizes.where(F.col("n") > max_bucket).select("bucket", F.ceil(F.col("n") / max_bucket).cast("int").alias("parts")), f"{base}/large", n=F.count("*"))
    if seen["n"]:
        large = F.broadcast(large) if seen["n"] <= BROADCAST_ROWS else large
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        cut = placed.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
        tile = F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.col("parts") - 1),
                    lambda j: F.when(j == F.col("part"), F.array(F.struct(j.alias("q"), j.alias("d"), F.lit(3).alias("role")))).otherwise(
                        F.array(F.struct(F.col("part").alias("q"), j.alias("d"), F.lit(1).alias("role")), F.struct(j.alias("q"), F.col("part").alias("d"), F.lit(2).alias("role")))
                    ),
                )
            )
        )
        tiles = cut.select("bucket", "id", "v", tile.alias("tile")).select("bucket", F.col("tile.q").alias("q"), F.col("tile.d").alias("d"), "id", "v", F.col("tile.role").alias("role"))
        groups = tiles.groupBy("bucket", "q", "d")
    else:
        groups = placed.groupBy("bucket")
    lists = groups.applyInArrow(_reranker(k, dim), "id bigint, ids array<bigint>, minus array<double>")
    every = F.flatten(F.collect_list(F.arrays_zip("minus", "ids")))
    best = F.slice(F.array_sort(F.array_distinct("every")), 1, k)
    merged = lists.groupBy("id").agg(every.alias("every")).select("id", best.alias("best"))
    found = merged.select("id", F.col("best.ids").alias("ids"), F.transform("best.minus", lambda m: (-m).cast("float")).alias("similarities"))
    return found if extra is None else found.unionByName(extra)


def _copies(good: DataFrame, k: int, base: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Ids of copies beyond the k + 1 smallest of their vector, and their neighbours; None if there are none."""
    hashed = good.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h1", "h2")
    classes, seen = materialize(classes, f"{base}/copied", n=F.count("*"))
    if not seen["n"]:
        return None, None
    members = hashed.join(classes, ["h1", "h2"])
    # Spark limits each group before the shuffle too, so a vector of any number of copies is no hot group here.
    first = members.withColumn("at", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("at") <= k + 1)
    top = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    further, _ = materialize(members.join(top, ["h1", "h2"]).where(F.col("id") > F.element_at("ids", -1)).select("id", F.slice("ids", 1, k).alias("ids")), f"{base}/further")
    return further, further.select("id", "ids", F.array_repeat(F.lit(1.0).cast("float"), k).alias("similarities"))


def _reranker(k: int, dim: int):
    """Nearest of a bucket's (or tile's) queries among its data, as Arrow tables; role 1: query, 2: data, 3 or none: both."""

    def run(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        raw = np.frombuffer(b"".join(group["v"].to_pylist()), np.float32).reshape(-1, dim)[order]
        role = group["role"].to_numpy()[order] if "role" in group.column_names else np.full(len(ids), 3)
        v = raw.astype(np.float64)
        v /= np.linalg.norm(v, axis=1)[:, None]
        data = np.flatnonzero(role & 2)
        # Equal vectors are one candidate, so that ties among them can't push each other off the short list.
        _, first, of = np.unique(raw[data].view(np.dtype((np.void, 4 * dim))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(of, kind="stable")
        at = np.arange(len(by)) - np.searchsorted(of[by], of[by])
        members = np.full((len(first), min(k + 1, int(at.max(initial=0)) + 1)), NOBODY, np.int64)
        some = at < members.shape[1]
        members[of[by][some], at[some]] = ids[data][by][some]
        reps = v[data[first]]
        single = reps.astype(np.float32)
        asked = np.flatnonzero(role & 1)
        out_ids, out_minus, sizes, size = [], [], [], min(len(first), k + 1)
        # Each of two dot products may be off by the rounding of its factors and of its dim additions.
        margin = np.float32(2 * (dim + 4) * 2.0**-24)
        for s in range(0, len(asked) if size else 0, 512):
            rows = asked[s : s + 512]
            near = v[rows].astype(np.float32) @ single.T
            # The query itself may be one of the best, so the bound is of k + 1.
            short = near >= np.partition(near, len(first) - size, axis=1)[:, len(first) - size, None] - margin
            run_of = (np.cumsum(short.sum(1)) - 1) // PAIRS
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(run_of)) + 1):
                q, c = np.nonzero(short[part])
                asks = rows[part]
                exact = np.einsum("ij,ij->i", v[asks[q]], reps[c])
                named = members[c]
                there = (named != NOBODY) & (named != ids[asks[q]][:, None])
                n = there.sum(1)
                q, minus, named = np.repeat(q, n), -np.repeat(exact, n), named[there]
                best = np.lexsort((named, minus, q))
                ends_at = np.cumsum(np.bincount(q, minlength=len(part)))
                starts = np.concatenate([[0], ends_at[:-1]])
                best = best[np.arange(len(best)) - starts[q[best]] < k]
                out_ids.append(named[best])
                out_minus.append(minus[best])
                sizes.append(np.minimum(ends_at - starts, k))
        ends = pa.array(np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32))
        flat = lambda parts, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([[], *parts]), kind))
        return pa.table({"id": pa.array(ids[asked] if size else ids[:0], pa.int64()), "ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *out_ids]))), "minus": flat(out_minus, pa.float64())})

    return run


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(idea_a, idea_b), idea_a < idea_b: the pairs where at least one is in the other's list."""
    other = found.select("id", F.explode("ids").alias("other"))
    return other.select(F.least("id", "other").alias("idea_a"), F.greatest("id", "other").alias("idea_b")).distinct()
