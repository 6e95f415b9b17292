import numpy as np
import pytest

from sparkloom.llm import neighbours as nb

SCHEMA = "id bigint, e array<float>, v string, bucket int, h1 string"


def table(spark, vectors, extra=()):
    rows = [(int(i * 3), [float(x) for x in v], "clash", 1, "clash") for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(4)


def truth(v, k):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    return [[int(j) * 3 for j in np.lexsort((np.arange(len(v)), -s[i])) if j != i][:k] for i in range(len(v))]


def recall(got, want):
    return sum(len(set(got[i * 3]) & set(w)) for i, w in enumerate(want)) / sum(map(len, want))


@pytest.mark.parametrize("bucket, max_bucket", [(1536, 8192), (1536, 50), (50, 8192), (50, 40)])
def test_recall(spark, bucket, max_bucket):
    r = np.random.default_rng(1)
    v = (r.normal(size=(12, 16))[r.integers(0, 12, 400)] + 0.3 * r.normal(size=(400, 16))).astype(np.float32)
    v[100:140] = v[3]
    v[200:205] = v[7] * 2
    got = {x.id: x.ids for x in nb.nearest(table(spark, v), "id", "e", dim=16, bucket=bucket, max_bucket=max_bucket).collect()}
    assert all(len(x) == 10 and len(set(x)) == 10 and i not in x for i, x in got.items()) and len(got) == 400
    found = recall(got, truth(v, 10))
    assert found == 1.0 if bucket == 1536 else found >= 0.9


@pytest.mark.parametrize("spread, max_bucket, pairs", [(1e-6, 8192, 65_536), (1e-8, 8192, 1000), (1e-8, 50, 65_536)])
def test_near_copies(spread, max_bucket, pairs, spark, monkeypatch):
    monkeypatch.setattr(nb, "PAIRS", pairs, raising=False)
    r = np.random.default_rng(3)
    one = r.normal(size=16)
    near = one / np.linalg.norm(one) + np.sqrt(spread / 16) * r.normal(size=(400, 16))
    v = np.vstack([near * r.uniform(0.5, 2, (400, 1)), r.normal(size=(50, 16))]).astype(np.float32)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = [[int(j) * 3 for j in np.lexsort((np.arange(len(v)), -s)) if j != i][:10] for i, s in enumerate(u @ u.T)]
    got = {x.id: x.ids for x in nb.nearest(table(spark, v), "id", "e", dim=16, max_bucket=max_bucket).collect()}
    assert recall(got, want) > 0.999


def test_copies_have_the_smallest_ids(spark):
    v = np.eye(8, dtype=np.float32)[[0] * 60 + [1, 2, 3]]
    got = {x.id: x.ids for x in nb.nearest(table(spark, v), "id", "e", k=4, dim=8).collect()}
    assert got[177] == [0, 3, 6, 9] and got[0] == [3, 6, 9, 12] and got[6] == [0, 3, 9, 12] and len(got) == 63


def test_unusable_vectors(spark):
    bad = [(5000, None, "", 0, ""), (5001, [0.0] * 8, "", 0, ""), (5002, [1.0] * 7, "", 0, ""), (5003, [float("nan")] * 8, "", 0, ""), (5004, [None] * 8, "", 0, ""), (5005, [float("inf")] * 8, "", 0, ""), (None, [1.0] * 8, "", 0, "")]
    df = table(spark, np.eye(8, dtype=np.float32)[:2], bad)
    found = nb.nearest(df, "id", "e", dim=8)
    assert {x.id: x.ids for x in found.collect()} == {0: [3], 3: [0]}
    assert [tuple(x) for x in nb.neighbour_pairs(found).collect()] == [(0, 3)]
    assert nb.nearest(df.where("false"), "id", "e", dim=8).count() == 0
    assert nb.nearest(df.where("id >= 5000"), "id", "e", dim=8).count() == 0


def test_codes_within_the_radius_share_a_substring():
    r = np.random.default_rng(2)
    codes = r.integers(0, 2, (200, nb.TABLES * 5))
    for a in codes[:20]:
        for b in codes:
            if (a != b).sum() < nb.TABLES:
                assert any((a[t * 5 : t * 5 + 5] == b[t * 5 : t * 5 + 5]).all() for t in range(nb.TABLES))


def test_code_of_more_bits_than_dimensions(spark):
    r = np.random.default_rng(5)
    centre, turn = nb.learn_code(r.normal(size=(200, 8)), 20)
    assert turn.shape == (8, 20) and np.allclose(turn[:, :8].T @ turn[:, :8], np.eye(8)) and len(centre) == 8
    v = r.normal(size=(600, 8)).astype(np.float32)
    got = {x.id: x.ids for x in nb.nearest(table(spark, v), "id", "e", dim=8, bucket=50).collect()}
    assert len(got) == 600 and recall(got, truth(v, 10)) > 0.4
