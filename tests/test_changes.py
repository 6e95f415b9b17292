from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom import session
from sparkloom.operators import analytics, context, graph, lifecycle, search
from sparkloom.streaming import ingest

SPAN = "id bigint, session string, parent_id bigint, name string, summary string, start_line int, end_line int, depth int, created_at timestamp, topic_id bigint, start_time timestamp, end_time timestamp"
IDEA = "id bigint, span_id bigint, content string, intent string, confidence double, session string, created_at timestamp, message_time timestamp, forgotten boolean, extra string"


def spans(spark, rows):
    return spark.createDataFrame([(i, s, p, n, None, i, None, None, None, t, None, None) for i, s, p, n, t in rows], SPAN)


def ideas(spark, rows):
    return spark.createDataFrame([(i, sp, c, k, conf, s, day and datetime(2021, 3, day), None, gone, "x") for i, sp, c, k, conf, s, day, gone in rows], IDEA)


def test_merge_spans(spark):
    s = spans(spark, [(1, "a", None, "Top ", 1), (2, "a", 1, "top", 1), (3, "a", 2, "leaf", 1), (4, "b", None, "top", 1), (5, "a", 2, None, 1), (6, None, None, "top", 1)])
    i = ideas(spark, [(10, 2, "x", None, None, "a", 1, None), (11, None, "y", None, None, "a", 1, None), (12, 4, "z", None, None, "b", 1, None)])
    pairs = lifecycle.same_spans(s)
    assert [tuple(x) for x in pairs.collect()] == [(2, 1)]
    left, moved = lifecycle.merge_spans(s, i, pairs)
    assert {x.id: x.parent_id for x in left.collect()} == {1: None, 3: 1, 4: None, 5: 1, 6: None}
    assert {x.id: x.span_id for x in moved.collect()} == {10: 1, 11: None, 12: 4} and moved.columns == i.columns
    assert lifecycle.same_spans(s.where("false")).count() == 0
    below = spark.createDataFrame([(1, 2)], "source bigint, target bigint")
    assert {x.id: x.parent_id for x in lifecycle.merge_spans(s, i, below)[0].collect()}[2] is None


def test_delete_and_prune(spark):
    s = spans(spark, [(1, "a", None, "n", 7), (2, "a", None, "m", 8), (3, "a", None, "o", None)])
    i = ideas(spark, [(10, 1, "x", None, None, "a", 1, None), (11, 2, "y", "decision", None, "a", 19, None), (12, None, "z", None, None, "a", None, None)])
    topics = spark.createDataFrame([(7, "t"), (8, "u")], "id bigint, name string")
    left, kept, rest = lifecycle.delete_topics(s, i, topics, topics.where("id = 7").select("id"), True)
    assert {x.id: x.topic_id for x in left.collect()} == {1: None, 2: 8, 3: None} and {x.id for x in kept.collect()} == {11, 12} and rest.count() == 1
    relations = spark.createDataFrame([(1, 10, 11, "answers"), (2, 11, 12, "answers")], "id bigint, from_id bigint, to_id bigint, relation_type string")
    kept, rest = lifecycle.prune_old(i, relations, F.lit("2021-03-20"), 14)
    assert {x.id for x in kept.collect()} == {11, 12} and [x.id for x in rest.collect()] == [2]


def test_consolidated_and_answered(spark):
    s = spans(spark, [(1, "a", None, "n", 7)])
    rows = [(i, 1, f"c{i}", "context", 0.5, "a", 1, False) for i in (3, 4, 5)] + [(6, 1, "d", "decision", 0.5, "a", 1, False), (7, 1, "e", "context", 0.5, "a", 1, True), (8, 1, "q", "question", 0.95, "a", 1, None)]
    i = ideas(spark, rows)
    done, made = lifecycle.consolidated(i, s, F.lit("2021-03-20"))
    assert [(x.id, x.topic_id, x.content, x.sources) for x in made.collect()] == [(9, 7, "c3 | c4 | c5", 3)]
    assert {x.id: x.consolidated_into for x in done.collect()} == {3: 9, 4: 9, 5: 9, 6: None, 7: None, 8: None}
    assert lifecycle.consolidated(i.where("false"), s, F.lit("2021-03-20"))[1].count() == 0
    relations = spark.createDataFrame([(1, 7, 8, "answers"), (2, 3, 6, "answers")], "id bigint, from_id bigint, to_id bigint, relation_type string")
    i = i.withColumn("answered", F.lit(False))
    assert not any(x.answered for x in lifecycle.answered(i, relations).collect())
    more = relations.unionByName(spark.createDataFrame([(3, 3, 8, "answers"), (3, 3, 8, "answers")], relations.schema))
    assert [x.id for x in lifecycle.answered(i, more).collect() if x.answered] == [8]


def test_walk_and_neighbours(spark):
    r = spark.createDataFrame([(1, 1, 2, "a"), (2, 1, 3, "a"), (3, 1, 3, "a"), (4, 2, 4, None), (5, 1, 9, "a")], "id bigint, from_id bigint, to_id bigint, relation_type string")
    i = ideas(spark, [(k, None, "c", None, None, "a", 1, None) for k in (1, 2, 3, 4)])
    inside = graph.among(r, i)
    assert sorted(x.id for x in inside.collect()) == [1, 2, 3, 4]
    got = {(x.seed, x.id): x.hop for x in graph.walk(i.where("id = 1"), inside, 3, "out", 1).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 4): 2}
    near = {(x.id, x.direction, x.relation_type): (x.n, x.others) for x in graph.neighbours(inside, 1).collect()}
    assert near[1, "out", "a"] == (2, "2") and near[2, "out", None] == (1, "4") and near[4, "in", None] == (1, "2")


def test_told_and_after(spark):
    i = ideas(spark, [(1, 1, None, None, 0.1, "a", 1, None), (2, 1, "two", "todo", None, "b", 2, None), (3, 1, "three", "todo", 0.9, "b", 3, True), (4, None, "four", "todo", 0.9, None, 4, None)])
    s = spans(spark, [(1, "a", None, None, 5)])
    assert [tuple(x) for x in context.topic_reflection(i, s).collect()] == [(5, "- [context] \n- [todo] two")]
    assert [x.text for x in context.span_texts_confident(s, i).collect()] == ["\ntwo"]
    assert {x.id for x in analytics.after_session(i, "a").collect()} == {2, 3, 4} and analytics.after_session(i, "none").count() == 4
    assert analytics.latest_spans(s).first().span_id == 1 and context.topic_reflection(i.where("false"), s).count() == 0


def test_search_auto(spark):
    asked = spark.createDataFrame(
        [(1, "simple", ["cache"], None, None, None), (2, "intent_scoped", ["cache"], "todo", None, None), (3, "relation", ["cache", "index"], None, None, None), (4, "conjunction", ["cold cache", "big index"], None, datetime(2021, 3, 2), datetime(2021, 3, 3)), (5, "simple", [""], None, None, None)],
        "query_id bigint, kind string, parts array<string>, intent string, since timestamp, until timestamp",
    )
    rows = spark.createDataFrame([(1, "cache index", "todo", datetime(2021, 3, 2)), (2, "cold cache", "context", datetime(2021, 3, 9)), (3, None, None, None), (4, "big index", None, datetime(2021, 3, 3))], "id bigint, text string, intent string, at timestamp")
    got = {}
    for x in search.search_auto(asked, rows, 5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.id)
    assert set(got[1]) == {1, 2} and got[2] == [1] and got[3][0] == 1 and set(got[3]) == {1, 2, 4} and set(got[4]) == {1, 4} and 5 not in got


def test_stream_rows_are_put_in_order():
    chunks = [pd.DataFrame({"byte_start": [30, 10], "at": [3, 1]}), pd.DataFrame({"byte_start": [20, 0], "at": [2, 0]})]
    assert list(ingest.in_order(iter(chunks), "at")) == [(0, 0), (10, 1), (20, 2), (30, 3)]


def test_shared_folders_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "made", [])
    df, got = session.materialize(spark.range(3), session.shared_dir(spark), n=F.count("*"))
    assert df.count() == 3 == got["n"] and session.clear_shared(spark) == 1 and session.clear_shared(spark) == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:  # noqa: N801
            of: dict = {}
            get = staticmethod(lambda key, default=None: Session.conf.of.get(key, default))

    monkeypatch.setattr(session, "own", {})
    monkeypatch.setattr(session, "made", [])
    Session.conf.of = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        session.shared_dir(Session)
    Session.conf.of = {"spark.master": "local-cluster[3,2,1000]"}
    with pytest.raises(ValueError):
        session.shared_dir(Session)
    Session.conf.of = {"spark.master": "local[4]"}
    assert session.shared_dir(Session).startswith(session.own["root"]) and session.shared_dir(Session) != session.shared_dir(Session)
    Session.conf.of = {"spark.master": "spark://host:7077", "spark.checkpoint.dir": "/shared"}
    assert session.shared_dir(Session).startswith("/shared/sparkloom-")
