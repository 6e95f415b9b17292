import random

import pytest
from pyspark.sql import Row

from sparkloom.llm import splitting as sp


@pytest.mark.parametrize("limit, overlap", [(100, 10), (160, 16), (50, 0), (21, 5)])
def test_pieces_cover_the_text(limit, overlap):
    r = random.Random(limit)
    for _ in range(150):
        text = "".join(r.choice(["word ", "a. ", "\n", "\n\n", "\r\n", "Z" * r.randint(1, 3 * limit), "x", "  ", "。", "é", "😀"]) for _ in range(r.randint(0, 150)))
        pieces = sp.split_text(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][2] == "end"
        assert all(b - a <= limit for a, b, _ in pieces)
        for (a, b, _), (c, d, _) in zip(pieces, pieces[1:], strict=False):
            assert a <= c and b - overlap <= c <= b < d


def test_natural_boundaries():
    paragraph = "One sentence here. " * 20
    text = (paragraph.strip() + "\n\n") * 12
    assert {c for _, _, c in sp.split_text(text)} == {"paragraph", "end"}
    assert {c for _, _, c in sp.split_text("word " * 1000)} == {"word", "end"}
    assert {c for _, _, c in sp.split_text("x" * 5000)} == {"hard", "end"}
    assert sp.split_text("x" * 1600) == [(0, 1600, "end")]
    for a, b, _ in sp.split_text(text)[1:]:
        assert text[a - 1].isspace() or text[a:b].startswith(text[a])


def cost(text, cuts, limit, overlap):
    places, kinds = sp.cut_places(text, limit, overlap)
    kind, begin = dict(zip(places, kinds, strict=True)), dict(zip(places, sp.starts_after(text, places, overlap), strict=True))
    total, start = 0.0, 0
    for e in cuts:
        if e - start > limit:
            return float("inf")
        total += ((limit - (e - start)) / limit) ** 2 + sp.COSTS[kind[e]] + 0.05
        start = begin[e]
    return total


def test_the_cheapest_split_is_found():
    from itertools import combinations

    r = random.Random(9)
    for _ in range(40):
        text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 9))) + r.choice(["", ".", ".\n"]) for _ in range(12))
        if len(text) <= 40:
            continue
        places, _ = sp.cut_places(text, 40, 6)
        best = min(cost(text, [*c, places[-1]], 40, 6) for n in range(5) for c in combinations(places[:-1], n))
        mine = cost(text, [e for _, e, _ in sp.split_text(text, 40, 6)], 40, 6)
        assert abs(mine - best) < 1e-9


def test_split_long(spark):
    rows = [(1, None), (2, ""), (3, "x" * 1600), (4, "y " * 900), (4, "y " * 900), (5, "z" * 2000), (6, "w " * 300_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id bigint, text string, key string, piece int")
    got = sp.split_long(df, "id", "text").collect()
    assert {x.id for x in got} == {4, 5, 6}
    texts = dict(rows)
    assert all(x.text == texts[x.id][x.start : x.stop] and len(x.text) <= 1600 for x in got)
    assert [x.broken for x in sorted(got, key=lambda x: x.piece) if x.id == 5][:-1] == [2000] * (sum(x.id == 5 for x in got) - 1) and not any(x.broken for x in got if x.id != 5)
    assert sum(x.piece == 0 for x in got if x.id == 4) == 2
    assert sp.split_long(df.where("false"), "id", "text").count() == 0
    with pytest.raises(ValueError):
        sp.split_long(df, "id", "text", 100, 50)


def test_records(spark):
    long = "word " * 400
    block = '[{"type":"text","text":"' + "v " * 900 + '"}]'
    rows = [(1, "user", long, None), (2, "user", long, "{}"), (3, "system", long, None), (4, "assistant", block, None), (5, "assistant", block[:-1], None), (6, "user", None, None), (7, "user", "short", None)]
    schema = "rec_id bigint, source_file string, line_num int, type string, message struct<role string, content string>, tool_use_result string, text string"
    df = spark.createDataFrame([(i, "f", i, t, Row(role=t, content=c), u, "clash") for i, t, c, u in rows] + [(8, "f", 1, "user", Row(role="user", content=long), None, "again")], schema)
    assert {x.rec_id for x in sp.record_pieces(df).collect()} == {1, 4}


def test_broken_records(spark):
    texts = {1: "word " * 400, 2: "x" * 1601, 3: "a " * 700 + "y" * 1600 + " b", 4: "a " * 700 + "y" * 1601 + " b", 5: ("é" * 1500 + "\n") * 2, 6: "x" * 1601 + " " + "y" * 5000, 7: ("z" * 1650 + "\u2003") * 3}
    schema = "rec_id bigint, source_file string, line_num int, type string, message struct<role string, content string>, tool_use_result string"
    df = spark.createDataFrame([(i, "f", i, "user", Row(role="user", content=t), None) for i, t in texts.items()], schema)
    got = {x.rec_id: x.unbroken for x in sp.broken_records(df).collect()}
    assert got == {i: int(max(map(len, t.split())) > 1600) for i, t in texts.items()}
