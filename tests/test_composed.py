"""Fused searches, clusters within topics, entity search, and what is stored or linked, against small brute force."""

import numpy as np
import pytest

from sparkloom.operators import clusters, entities, graph, lifecycle, nearest, search


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_knn_stays_out_of_the_querys_group(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    of = [int(i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([(i, v[i].tolist(), of[i]) for i in range(60)], "id bigint, v array<double>, of bigint")
    got = {(r["query_id"], r["rank"]): r["id"] for r in nearest.knn(df.where("id < 9"), df, 4, 8, apart="of", most=3).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(9):
        others = sorted((round(-float(u[q] @ u[i]), 9), i) for i in range(60) if of[i] != of[q])[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in others]


def test_further_adds_what_the_first_rows_lead_to_once(spark):
    found = spark.createDataFrame([(7, 1, 10, 0.5, "both"), (7, 2, 11, 1.0, "vector"), (7, 3, 12, 2.0, "vector"), (7, 4, 13, 3.0, "vector")], "query_id bigint, rank int, id bigint, score double, found string")
    similar = spark.createDataFrame([(10, 1, 11), (10, 2, 20), (11, 1, 20), (11, 2, 21), (13, 1, 30)], "query_id bigint, rank int, id bigint")
    more = search.further(found, similar)
    assert rows(more.where("found = 'similar'"), "query_id", "rank", "id", "similar_to") == [(7, 5, 20, 10), (7, 6, 21, 11)]
    assert more.where("found <> 'similar'").count() == 4
    assert search.further(found.limit(0), similar).count() == 0


def test_report_and_timeline(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "query_id bigint, rank int, id bigint")
    ideas = spark.createDataFrame([(10, "a", 1, "todo"), (11, "a", None, None), (12, None, 2, "todo")], "id bigint, session string, topic_id bigint, intent string")
    assert rows(search.report(found, ideas), "query_id", "ideas", "sessions", "topics", "kinds") == [(1, 3, 1, 2, "todo: 2, unknown: 1")]
    assert rows(search.report(found, ideas, 1), "kinds") == [("todo: 1",)]
    times = spark.sql("SELECT * FROM VALUES (10, TIMESTAMP '2021-03-02 01:00:00'), (11, null), (12, TIMESTAMP '2021-03-02 00:00:00') AS t(id, at)")
    assert rows(search.timeline(found, times), "query_id", "date", "ids") == [(1, "2021-03-02", "10,12")]


@pytest.mark.parametrize("limit", [80_000, 0])
def test_subclusters_are_those_of_lloyd(spark, monkeypatch, limit):
    monkeypatch.setattr(clusters, "BROADCAST_CENTRES", limit)
    rng = np.random.default_rng(3)
    topics = [1] * 40 + [2] * 9 + [3] * 3
    v = np.round(rng.normal(size=(len(topics), 4)) + np.array([[5 * (i % 3), 0, 0, 0] for i in range(len(topics))]), 6)
    v[1] = v[0]
    df = spark.createDataFrame([(i, t, v[i].tolist()) for i, t in enumerate(topics)], "id bigint, topic_id bigint, v array<double>")
    hashes = {r[0]: r[1] for r in df.selectExpr("id", "xxhash64(id)").collect()}
    got = {r["id"]: (r["cluster"], r["distance"]) for r in clusters.subclusters(df, dim=4).collect()}
    assert not any(topics[i] == 3 for i in got)
    for t, k in ((1, 6), (2, 3)):
        ids = [i for i in range(len(topics)) if topics[i] == t]
        centres = np.array([v[i] for i in sorted(ids, key=lambda i: (hashes[i], i))[:k]])
        for _ in range(20):
            d = np.round(((v[ids][:, None] - centres[None]) ** 2).sum(2), 9)
            near = d.argmin(1)
            before = centres
            centres = np.array([np.round(v[ids][near == c].mean(0), 9) if (near == c).any() else centres[c] for c in range(k)])
        assert (before == centres).all()
        assert [got[i][0] for i in ids] == near.tolist()
        assert np.allclose([got[i][1] for i in ids], d.min(1), atol=1e-8)
    parts = clusters.split(clusters.subclusters(df, dim=4)).collect()
    assert sum(p["size"] for p in parts) == 49 and all(p["child"] == (p["size"] >= 3) for p in parts)
    assert clusters.subclusters(df.limit(0), dim=4).count() == 0


def test_entity_search_prefers_the_same_name(spark):
    golden = spark.createDataFrame([(1, "Redis", "technology"), (2, "redis", "concept"), (3, "PostgreSQL", "technology"), (4, None, None)], "id bigint, canonical_name string, type string")
    mentions = spark.createDataFrame([(1,), (1,), (3,), (None,)], "golden_id bigint")
    names = spark.createDataFrame([("Redis",), ("Redis",), ("REDIS",), ("PostgresSQL",), ("nothing like it",), ("",), (None,)], "name string")
    found = entities.search_entities(names, golden, mentions)
    assert rows(found, "name", "golden_id", "mention_count") == [("PostgresSQL", 3, 1), ("REDIS", 1, 2), ("Redis", 1, 2)]
    assert rows(entities.search_entities(names, golden, mentions, "concept"), "name") == []
    assert entities.search_entities(names, golden.limit(0), mentions).count() == 0


def test_relations_from_lines(spark):
    ideas = spark.createDataFrame([(5, "f", 1), (4, "f", 1), (6, "f", 2), (7, None, 3)], "id bigint, source_file string, source_line int")
    proposed = spark.createDataFrame([("f", 1, 6, None), ("f", 1, 6, None), ("f", 2, 99, "x"), ("g", 1, 6, "x"), (None, 3, 6, "x"), ("f", 2, 4, "x")], "source_file string, from_line int, to_id bigint, type string")
    known = spark.createDataFrame([(6, 4, "x")], "from_id bigint, to_id bigint, relation_type string")
    assert rows(graph.executed_relations(proposed, ideas, known), "from_id", "to_id", "relation_type") == [(4, 6, "related")]
    assert len(rows(graph.executed_relations(proposed, ideas, known.limit(0)), "from_id")) == 2


def test_links_are_replaced_by_pair(spark):
    schema = "topic_id bigint, related_topic_id bigint, similarity double, link_type string"
    links = spark.createDataFrame([(1, 2, 0.9, "semantic"), (2, 1, 0.9, "semantic")], schema)
    fresh = spark.createDataFrame([(1, 2, 0.5, "manual"), (1, 2, 0.4, "manual"), (3, 1, None, "merged")], schema)
    assert rows(graph.link_topics(links, fresh), "topic_id", "related_topic_id", "similarity", "link_type") == [(1, 2, 0.5, "manual"), (2, 1, 0.9, "semantic"), (3, 1, None, "merged")]


def test_stored_ideas_and_topic_names(spark):
    schema = "id bigint, source_file string, source_line int, content string"
    ideas = spark.createDataFrame([(1, "f", 1, "a")], schema)
    fresh = spark.createDataFrame([(2, "f", 1, "b"), (4, "f", 2, "c"), (3, "f", 2, "d"), (5, None, 1, "e"), (6, "f", None, "f")], schema)
    assert rows(lifecycle.store_ideas(ideas, fresh), "id") == [(3,), (5,), (6,)]
    messages = spark.sql(
        """SELECT * FROM VALUES (1, 's', 'f', 1, 'second message of the day', TIMESTAMP '2021-03-02 00:00:00'), (2, 's', 'f', 2, 'Rate limiting design for uploads', TIMESTAMP '2021-03-01 00:00:00'),
        (3, 't', 'f', 3, 'ok', CAST(null AS TIMESTAMP)), (4, CAST(null AS STRING), 'f', 4, 'Nobody session here', null), (5, 'u', null, null, CAST(null AS STRING), null) AS m(rec_id, session, source_file, line_num, content, sent_at)"""
    )
    assert rows(lifecycle.topic_names(messages), "session", "name") == [("s", "Rate limiting design for uploads"), ("t", "Discussion"), ("u", "Discussion")]
