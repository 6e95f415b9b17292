import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.functions.blocks import block_text, parse_json, standing
from sparkloom.operators import hierarchy, shredding

RECORD = "rec_id bigint, source_file string, line_num int, message struct<role string, content string>, content string, leaf string, key int"


def brute_objects(value):
    out, stack = set(), [(value, (), "")]
    while stack:
        v, path, parent = stack.pop()
        if isinstance(v, dict):
            here = ".".join(path)
            out.add((here, parent))
            stack += [(x, (*path, k), here) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, (*path, str(i)), parent) for i, x in enumerate(v)]
    return out


def brute_values(value):
    out, stack = set(), [(value, ())]
    while stack:
        v, path = stack.pop()
        if isinstance(v, dict):
            stack += [(x, (*path, k)) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, (*path, str(i))) for i, x in enumerate(v)]
        else:
            out.add((".".join(path), v if isinstance(v, str) else json.dumps(v)))
    return out


def some_json(r, depth=0):
    kind = r.random()
    if depth > 4 or kind < 0.3:
        return r.choice([1, -2.5, True, None, "", "x", "ü 😀", '{"a": 1}'])
    if kind < 0.65:
        return {r.choice(["a", "b", "c.d", "", "0"]): some_json(r, depth + 1) for _ in range(r.randint(0, 3))}
    return [some_json(r, depth + 1) for _ in range(r.randint(0, 4))]


def records(spark, contents):
    rows = [(i + 1, "f", i, None if c is None else Row(role="user", content=c), "clash", "clash", 1) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, RECORD)


def test_shredding_equals_a_walk(spark):
    r = random.Random(3)
    values = [[{"x": some_json(r)} if r.random() < 0.5 else some_json(r) for _ in range(r.randint(1, 4))] for _ in range(120)]
    values = [[{}, *v] for v in values]
    df = records(spark, [json.dumps(v) for v in values])
    got = {(x.rec_id, x.node_path, x.parent_path) for x in shredding.content_objects(df).collect()}
    assert got == {(i + 1, *n) for i, v in enumerate(values) for n in brute_objects(v)}
    rows = shredding.content_values(df).collect()
    assert {(x.rec_id, x.node_path, x.value) for x in rows} == {(i + 1, *n) for i, v in enumerate(values) for n in brute_values(v)}
    assert len(rows) == sum(len(brute_values(v)) for v in values)


def test_shredding_cases(spark):
    deep = "[" + '{"a":[' * 3000 + "1" + "]}" * 3000 + "]"
    contents = [None, "", "[]", "plain [{", "[{", '[{"a":NaN}]', '[{"a":1}] x', '[{"a":"\\ud83d"}]', '[{"a":1,"a":{"b":2}}]', deep, '[{},{},{"k":[[],[{}]]}]']
    got = {}
    for x in shredding.content_objects(records(spark, contents)).collect():
        got.setdefault(x.rec_id, set()).add((x.node_path, x.parent_path))
    assert sorted(got) == [8, 9, 10, 11]
    assert got[9] == {("0", ""), ("0.a", "0")}
    assert len(got[10]) == 3000
    assert got[11] == {("0", ""), ("1", ""), ("2", ""), ("2.k.1.0", "2")}
    assert shredding.content_objects(records(spark, [])).count() == 0


def test_first_delivery_stands(spark):
    rows = [(5, "f", 1), (3, "f", 1), (4, "f", 1), (6, None, 1), (7, None, 1), (8, "f", None)]
    df = spark.createDataFrame(rows, "rec_id bigint, source_file string, line_num int")
    assert sorted(x.rec_id for x in standing(df).collect()) == [3, 6, 7, 8]


@pytest.mark.parametrize("text", ["[1,2", "[1,]", "{'a':1}", "[{\"a\"}]", "[NaN]", "[1] 2", '["a\n"]', "", "[01]"])
def test_strict_json(text):
    with pytest.raises(ValueError):
        parse_json(text)
    with pytest.raises(ValueError):
        from sparkloom.functions.blocks import _parse_deep

        _parse_deep(text)


def test_deep_parser_equals_json():
    from sparkloom.functions.blocks import _parse_deep

    r = random.Random(5)
    for _ in range(300):
        v = some_json(r)
        assert _parse_deep(json.dumps(v)) == v == _parse_deep(f" {json.dumps(v, indent=1)} ")


def test_block_text():
    assert block_text('[{"type":"text","text":"a"},{"type":"text","text":5},{"type":"x","text":"b"},{"type":"text","text":"c"}]') == ("a\nc", False, False)
    assert block_text('[{"type":"tool_use"}]') == (None, False, True)
    assert block_text("[{") == (None, True, False)


def brute_tree(parent):
    out = {}
    for i in parent:
        chain, loop = [i], 0
        while (p := parent[chain[-1]]) is not None and p in parent:
            if p in chain:
                loop = min(chain[chain.index(p) :])
                break
            chain.append(p)
        out[i] = (0, "", None, loop) if loop else (chain[-1], "/".join(map(str, chain[::-1])), len(chain) - 1, 0)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star", "circle"])
def test_hierarchy_equals_a_walk(spark, shape):
    r = random.Random(7)
    n = 60
    parent = {
        "random": {i: r.choice([None, 999, *range(1, n)]) for i in range(1, n)},
        "chain": {i: i - 1 or None for i in range(1, n)},
        "star": {i: 1 if i > 1 else None for i in range(1, n)},
        "circle": {i: i % 40 + 1 if i <= 40 else r.randint(1, i - 1) for i in range(1, n)},
    }[shape]
    rows = [(i, p, "clash", i) for i, p in parent.items()] + [(5, parent[5], "again", 0), (None, 3, "x", 0)]
    df = spark.createDataFrame(rows, "id bigint, parent_id bigint, path string, depth int")
    found = hierarchy.hierarchy(df).cache()
    assert {x.id: (x.root_id, x.path, x.depth, x.loop_id) for x in found.collect()} == brute_tree(parent)
    want = {(int(a), i, d - k) for i, (_, path, d, _) in brute_tree(parent).items() if path for k, a in enumerate(path.split("/")[:-1])}
    assert {tuple(x) for x in hierarchy.descendants(found).collect()} == want
    below = {x.id: x.below for x in hierarchy.subtree_sizes(df).collect()}
    assert sum(below.values()) == len(want) and len(below) == len(parent)
    assert all(n == sum(a == i for a, _, _ in want) for i, n in below.items())


def test_hierarchy_of_nothing_and_of_itself(spark):
    empty = spark.createDataFrame([], "id bigint, parent_id bigint")
    assert hierarchy.hierarchy(empty).count() == 0
    one = hierarchy.hierarchy(spark.createDataFrame([(4, 4), (2, 4), (9, None)], "id bigint, parent_id bigint"))
    assert {x.id: (x.root_id, x.loop_id, x.path) for x in one.collect()} == {4: (0, 4, ""), 2: (0, 4, ""), 9: (9, 0, "9")}
    assert one.where(F.col("loop_id") == 0).count() == 1
