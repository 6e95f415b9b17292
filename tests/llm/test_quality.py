import os

import numpy as np
import pytest

from sparkloom.llm import quality as ql

DATA = "/root/testdata"


def stats(spark, texts, common=("the", "is")):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, _lines string, n_words int")
    return {x.doc_id: x for x in ql.statistics(df, "doc_id", "text", list(common)).collect()}


def test_statistics(spark):
    got = stats(spark, ["The cat is.\nA dog", "- one\n- two", "| a | b |\n| c | d |", "x_1 y", None, "", " \t\n ", "a" * 200_000, "Ü ünd é."])
    a = got[0]
    assert (a.n_words, a.n_lines, a.n_chars) == (5, 2, 17) and a.punct_lines == 0.5 and a.common_share == pytest.approx(0.4)
    assert a.mean_word == pytest.approx(13 / 5) and a.symbol_ratio == pytest.approx(1 / 13) and a.upper_ratio == pytest.approx(2 / 13)
    assert got[1].list_share == 1.0 and got[2].table_share == 1.0 and got[3].name_share == 0.5
    for i in (4, 5, 6):
        assert got[i].n_words == 0 and all(v in (0, 0.0) for k, v in got[i].asDict().items() if k in ("mean_word", "symbol_ratio", "common_share", "punct_lines"))
    assert got[7].long_share == 1.0 and got[8].n_words == 3
    assert stats(spark, []) == {}


def test_rules_are_learned_and_exported(spark):
    r = np.random.default_rng(0)
    x = r.random((300, 3))
    kinds = np.where(x[:, 0] > 0.7, "a", np.where(x[:, 1] <= 0.2, "b", "z"))
    rules, default = ql.induce(x, kinds, ("p", "q", "s"), tries=5)
    assert default == "z" and {k for k, _ in rules} == {"a", "b"}
    df = spark.createDataFrame([(*map(float, row), k) for row, k in zip(x, kinds, strict=True)], "p double, q double, s double, k string")
    wrong = df.where(f"({ql.rules_case(rules, default)}) <> k").count()
    assert wrong <= 6
    assert ql.rules_case([], "z") == "'z'"


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="no test tables here")
def test_held_out_accuracy(spark):
    read = lambda sf, t: spark.read.parquet(f"{DATA}/{sf}/{t}.parquet")
    common = ql.common_words(read("sf0.1", "common_words"))
    rules, default = ql.learn(read("sf0.1", "documents"), "doc_id", "text", read("sf0.1", "doc_labels"), "kind", common)
    other = read("sf0.01", "documents").join(read("sf0.01", "doc_labels"), "doc_id")
    kinds = ql.statistics(other, "doc_id", "text", common).selectExpr("doc_id", f"{ql.rules_case(rules, default)} AS found").join(other.select("doc_id", "kind"), "doc_id").collect()
    hit = sum(x.found != "prose" and x.kind != "prose" for x in kinds)
    assert hit / sum(x.found != "prose" for x in kinds) > 0.93 and hit / sum(x.kind != "prose" for x in kinds) > 0.93


def test_without_labels_all_is_prose(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, "junk"), (None, "list"), (1, None)], "doc_id bigint, kind string")
    words = spark.createDataFrame([("en", "the"), ("en", None)], "lang string, word string")
    assert {x.doc_id: x.kind for x in ql.classified(docs, labels, words).collect()} == {1: "prose", 2: "blank"}


def test_common_words_of_any_number(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat is here"), (1, "the cat is here"), (1, "a b"), (None, "the the"), (2, None), (3, "")], "doc_id bigint, text string")
    words = spark.createDataFrame([("en", "The"), ("en", "is"), ("de", "is"), ("en", None)], "lang string, word string")
    listed = ql.common_words(words)
    monkeypatch.setattr(ql, "COMMON", 1)
    table = ql.common_words(words)
    assert listed == ["is", "the"] and not isinstance(table, list)
    rows = lambda common: sorted((str(x.doc_id), x.n_chars, x.common_share, x.mean_word) for x in ql.statistics(docs, "doc_id", "text", common).collect())
    assert rows(table) == rows(listed) and len(rows(table)) == 6
