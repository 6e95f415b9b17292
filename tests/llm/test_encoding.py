import os
import random

import pytest

from sparkloom.llm import encoding as en

pytestmark = pytest.mark.skipif(not os.path.exists(en.RANKS), reason="no rank file here")


@pytest.fixture(scope="module")
def enc():
    return en.encoding(en.load_ranks())


def test_cut_texts_give_the_same_ids(enc):
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice(["a", "b1", "12", " ", "  ", "\n", ".", "'s", "é", "　", "x's", " Z", "\t", "\x1c", "٣", "😀"]) for _ in range(r.randint(0, 60)))
        for size in (1, 3, 7):
            assert [i for p in en.chunks(text, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 1_000_000, "x" + "\n" * 500_000 + "y", "-" * 200_000, "12 ab " * 60_000, " " * 30_000 + "é" + "\t" * 20_000])
def test_very_long_texts(enc, text):
    assert enc.decode_bytes(en.encode_text(enc, text)).decode() == text


def test_long_space_as_the_pattern_has_it(enc, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(en, "LONG_SPACE", 0)
    monkeypatch.setattr(en, "SPACES", en.re.compile(r"[^\S\x1c-\x1f]{3,}"))
    for _ in range(500):
        text = "".join(r.choice(["a", " ", "  ", "\n", "    ", ".", "1"]) for _ in range(30))
        assert en.encode_text(enc, text) == enc.encode_ordinary(text)


def test_encode_and_decode(spark, enc):
    rows = [(1, None), (2, ""), (3, "Hello wörld <|endoftext|> 😀"), (3, "again"), (None, "x"), (4, "\r\n  \t")]
    df = spark.createDataFrame([(*r, [1], "clash") for r in rows], "doc_id bigint, text string, ids array<int>, r string")
    got = en.encode(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    found = {(x.doc_id, tuple(x.ids)) for x in got.collect()}
    assert found == {(i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows}
    assert max(i for _, ids in found for i in ids) < 50256
    back = {(x.doc_id, x.text) for x in en.decode(got, "doc_id").collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert all(x.same for x in en.round_trip(spark, df, "doc_id", "text").collect())
    assert en.encode(df.where("false"), "doc_id", "text").count() == 0
    partial = spark.createDataFrame([(1, [enc.encode_ordinary("😀")[0]]), (2, None), (3, [])], "i int, ids array<int>")
    assert {x.i: x.text for x in en.decode(partial, "i").collect()} == {1: "�", 2: None, 3: ""}
