import random

import numpy as np
import pytest

from sparkloom.llm import leakage as lk


WORDS = 4


def brute(docs, items):
    out = set()
    for item, text in items:
        w = [x.lower() for x in lk.WORD.findall(text or "")]
        k = min(len(w), WORDS)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for doc, t in docs:
            d = [x.lower() for x in lk.WORD.findall(t or "")]
            if any(tuple(d[i : i + k]) in grams for i in range(len(d) - k + 1)):
                out.add((doc, item))
    return out


def found(spark, docs, items, shard=1 << 18, most=150):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id int, text string, key string, item int").repartition(3)
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id int, text string, key string")
    return lk.leaks(d, "doc_id", "text", i, "item_id", "text", WORDS, shard, most)


def test_index_against_a_scan():
    r = np.random.default_rng(0)
    seq = np.append(r.integers(1, 5, 400), 0)
    index = lk.FMIndex(seq, 6)
    assert [tuple(seq[s:]) for s in lk.suffix_array(seq)] == sorted(tuple(seq[s:]) for s in range(len(seq)))
    phrases = r.integers(1, 6, (200, 4))
    lengths = r.integers(1, 5, 200)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
        want = [i for i in range(len(seq)) if list(seq[i : i + n]) == list(p[:n])]
        assert sorted(index.locate(np.arange(a, b))) == want
    assert np.array_equal(index.wavelet.rank(index.bwt, np.arange(len(seq))), [(index.bwt[:i] == c).sum() for i, c in enumerate(index.bwt)])


def test_filter_of_words(spark):
    seen = np.array([0, 1, 32767, 32768, 32769, 65536, lk.FILTER_BITS - 1, lk.FILTER_BITS + 5, 3 * lk.FILTER_BITS + 70000], np.int64)
    bits = np.unpackbits(lk.word_filter(spark.createDataFrame([(bytearray(seen[:5].tobytes()),), (bytearray(seen[5:].tobytes()),)], "phrase binary")), bitorder="little")
    assert sorted(np.flatnonzero(bits)) == sorted(seen % lk.FILTER_BITS)


@pytest.mark.parametrize(("shard", "most"), [(8, 150), (60, 150), (1 << 18, 150), (60, 30), (1 << 18, 30)])
def test_leaks_equal_a_scan(spark, shard, most):
    r = random.Random(shard)
    words = ["Ab", "b", "c", "ü", "7", "dd", "é"]
    text = lambda n, sep=(" ", ", ", "\n", "_"): "".join(r.choice(words) + r.choice(sep) for _ in range(n))
    items = [(i, text(r.randint(0, 9))) for i in range(12)] + [(90, None), (91, "?!"), (92, "b c"), (93, "b c")]
    docs = [(i, text(r.randint(0, 60), (" ", "x "))) for i in range(40)] + [(50, None), (51, ""), (52, text(400)), (53, "B-C"), (53, "b, c")]
    spans = found(spark, docs, items, shard, most)
    assert {tuple(x) for x in lk.leaked_items(spans, "doc_id", "item_id").collect()} == brute(docs, items)
    texts, by = dict(docs), dict(items)
    for x in spans.collect():
        if x.doc_id != 53:
            piece = [w.lower() for w in lk.WORD.findall(texts[x.doc_id][x.start : x.stop])]
            assert len(piece) >= min(4, len(lk.WORD.findall(by[x.item_id])))
    cut = lk.removal_spans(spans, "doc_id").orderBy("doc_id", "start").collect()
    assert all(a.doc_id != b.doc_id or a.stop < b.start for a, b in zip(cut, cut[1:], strict=False))
    assert {x.doc_id for x in cut} == {d for d, _ in brute(docs, items)}


def test_nothing_to_find(spark):
    assert found(spark, [(1, "a b")], []).count() == 0
    assert found(spark, [], [(1, "a b")]).count() == 0
    assert found(spark, [(1, "a b")], [(1, None)]).count() == 0
