"""Deeply nested records to flat related tables, by columnar shredding.

Each leaf path of a record becomes a column of entries. An entry has a repetition level (the list, counted from outside,
at which this entry starts a new element; 0 starts the record), a definition level (how many steps of the path are there)
and a value. Entries that only say "this element has no such leaf" are kept as runs, and left out at the end of a column,
so that a record takes space in proportion to what it holds, however different its objects are. The tables of the
repeated ancestors are then rebuilt from the level sequences alone: a running count per repetition level, set back by
every smaller level, gives the positions in all lists above an entry.

A leaf path is written as JSON: names as strings, lists as 0. Besides its values, every object has a leaf of its own, so
that empty objects are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import clean, parse_json, standing

LIST = 0
COLUMNS = "rep array<int>, def array<int>, run array<int>, value array<string>"


def shred_value(value, objects_only: bool = False) -> dict[tuple, tuple[list, list, list, list]]:
    """Level sequences of one parsed record by (path, kind); kind is object, list (empty ones) or value."""
    columns: dict[tuple, tuple] = {}
    last: dict[tuple, tuple] = {}
    stack = [(value, (), ())]
    while stack:
        v, path, at = stack.pop()
        if isinstance(v, dict):
            kind, v_text = "object", None
            for name in reversed(v):
                if not objects_only or isinstance(v[name], (dict, list)):
                    stack.append((v[name], (*path, name), at))
        elif isinstance(v, list):
            for i in range(len(v) - 1, -1, -1):
                if not objects_only or isinstance(v[i], (dict, list)):
                    stack.append((v[i], (*path, LIST), (*at, i)))
            if v or objects_only:
                continue
            kind, v_text = "list", None
        else:
            kind, v_text = "value", v if isinstance(v, str) else json.dumps(v)
        column = columns.setdefault((path, kind), ([], [], [], []))
        _append(column, path, last.get((path, kind)), at, v_text)
        last[path, kind] = at
    return columns


def _append(column: tuple, path: tuple, before: tuple | None, at: tuple, value) -> None:
    rep, dfn, run, values = column
    lists = [i + 1 for i, step in enumerate(path) if step == LIST]

    def missing(level: int, n: int) -> None:
        rep.append(level)
        dfn.append(lists[max(level, 1) - 1] - 1)  # the list is there, an element of this path isn't
        run.append(n)
        values.append(None)

    level = 0
    if before is None and any(at):
        missing(0, 1)
        before = (0,) * len(at)
    if before is not None:
        start = next(k for k, (a, b) in enumerate(zip(at, before, strict=True)) if a != b)
        steps = [(start + 1, at[start] - before[start]), *((k + 1, n) for k, n in enumerate(at) if k > start and n)]
        for k, n in steps[:-1]:
            missing(k, n)
        level, n = steps[-1]
        if n > 1:
            missing(level, n - 1)
    rep.append(level)
    dfn.append(len(path))
    run.append(1)
    values.append(value)


def positions(rep: np.ndarray, run: np.ndarray, levels: int) -> np.ndarray:
    """Positions in each list above every entry, for level sequences laid end to end (each starts at level 0)."""
    out = np.empty((levels, len(rep)), np.int64)
    for k in range(1, levels + 1):
        seen = np.cumsum(np.where(rep == k, run, 0))
        out[k - 1] = seen - np.maximum.accumulate(np.where(rep < k, seen, -1))
    return out


def _flat(lists: list[list], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for one in lists for x in one], kind))


def shred(records: DataFrame, key: str, document: str, objects_only: bool = False) -> DataFrame:
    """(key, leaf, kind, rep, def, run, value): the level sequences of each leaf path of each record's JSON document.

    Records without a document, or whose document isn't valid JSON, have no rows. objects_only reads only the objects'
    own leaves. The work is local to a record: no shuffle. Other columns of the input are not read.
    """
    source = records.select(F.col(key).alias("key"), F.col(document).alias("document")).where(F.col("document").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, leaves, kinds, parts = [], [], [], ([], [], [], [])
            names: dict[tuple, str] = {}
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = parse_json(text)
                except ValueError:
                    continue
                for (path, kind), column in shred_value(value, objects_only).items():
                    if path not in names:
                        names[path] = json.dumps([clean(s) if s != LIST else LIST for s in path], ensure_ascii=False)
                    keys.append(k)
                    leaves.append(names[path])
                    kinds.append(kind)
                    for whole, one in zip(parts, column, strict=True):
                        whole.append(one)
            texts = [[v if v is None else clean(v) for v in one] for one in parts[3]]
            for s in range(0, len(keys), 20_000):
                cut = slice(s, s + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[cut], batch.schema.field(0).type), pa.array(leaves[cut], pa.string()), pa.array(kinds[cut], pa.string()), *[_flat(p[cut], pa.int32()) for p in parts[:3]], _flat(texts[cut], pa.string())],
                    ["key", "leaf", "kind", "rep", "def", "run", "value"],
                )

    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(run, f"key {kind}, leaf string, kind string, {COLUMNS}").withColumnRenamed("key", key)


def _paths(steps: list, at: np.ndarray, upto: int) -> list[str]:
    """Dotted paths of the first upto steps at the given list positions (one row each)."""
    columns, k = [], 0
    for step in steps[:upto]:
        if step == LIST:
            columns.append([str(x) for x in at[k]])
            k += 1
        else:
            columns.append([step] * at.shape[1])
    return [".".join(x) for x in zip(*columns, strict=True)] if columns else [""] * at.shape[1]


def _holder(steps: list) -> int:
    """Number of steps that lead to the nearest object above this place."""
    return max((i for i, s in enumerate(steps) if isinstance(s, str)), default=0)


def _rebuild(shredded: DataFrame, key: str, kind: str, with_value: bool) -> DataFrame:
    columns = shredded.where(F.col("kind") == kind).select(F.col(key).alias("key"), "leaf", "def", "rep", "run", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, length, dfn = (batch.column(c).flatten().to_numpy() for c in ("rep", "run", "def"))
            value = batch.column("value").flatten()
            sizes = np.diff(batch.column("rep").offsets.to_numpy())
            ends = np.cumsum(sizes)
            coded = batch.column("leaf").dictionary_encode()
            leaf = np.asarray(coded.indices)
            of = np.repeat(np.arange(len(sizes)), sizes)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                steps = json.loads(name)
                mine = np.flatnonzero(leaf == code)
                rows = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in mine])
                at = positions(rep[rows], length[rows], sum(s == LIST for s in steps))
                there = dfn[rows] == len(steps)
                rows, at = rows[there], at[:, there]
                top = _holder(steps)
                keys = batch.column("key").take(pa.array(of[rows]))
                parent = pa.array(_paths(steps, at, top), pa.string())
                node = pa.array(_paths(steps, at, len(steps)), pa.string())
                shape = pa.array([".".join("*" if s == LIST else s for s in steps)] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [keys, node, parent, shape, *[value.take(pa.array(rows))] * with_value], ["key", "node_path", "parent_path", "shape", *["value"] * with_value]
                )

    kind_of = dict(columns.dtypes)["key"]
    return columns.mapInArrow(run, f"key {kind_of}, node_path string, parent_path string, shape string" + ", value string" * with_value).withColumnRenamed("key", key)


def object_table(shredded: DataFrame, key: str) -> DataFrame:
    """(key, node_path, parent_path, shape): one row for each object, tied to its record and to the object that holds it.

    shape is the path with * for positions: it names the table of a repeated ancestor, so one filter on it gives that table.
    """
    return _rebuild(shredded, key, "object", False)


def value_table(shredded: DataFrame, key: str) -> DataFrame:
    """(key, node_path, parent_path, shape, value): one row for each scalar, tied to the object that holds it. value is the
    string itself, or the JSON of a number, boolean or null."""
    return _rebuild(shredded, key, "value", True)


def content_objects(records: DataFrame) -> DataFrame:
    """(rec_id, node_path, parent_path): the objects in the block lists of transcript records.

    Damaged lists, plain texts and null contents have none; of a record delivered again only the first row counts, and rows
    without rec_id don't.
    """
    return object_table(shred(_block_lists(records), "rec_id", "content", objects_only=True), "rec_id").select("rec_id", "node_path", "parent_path")


def content_values(records: DataFrame) -> DataFrame:
    """(rec_id, node_path, parent_path, value): the scalars in the block lists of transcript records, as content_objects."""
    return value_table(shred(_block_lists(records), "rec_id", "content"), "rec_id").select("rec_id", "node_path", "parent_path", "value")


def _block_lists(records: DataFrame) -> DataFrame:
    lists = records.select("rec_id", F.col("message.content").alias("content")).where(F.col("content").startswith("[{"))
    return lists.join(standing(records), "rec_id", "left_semi")
