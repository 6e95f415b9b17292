import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import plugins
from sparkloom.operators import batching, entities, graph, lifecycle, nearest, ordering, records, search
from sparkloom.sources import exchange


def test_running_over_groups_of_any_size(spark, many_stretches):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "a", None]), i, r.choice([None, r.randint(0, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, x int").repartition(7)
    laid = ordering.lay_out(df, ["g"], ["i"])
    got = ordering.running(laid, ["g"], ["i"], sums={"n": F.lit(1), "s": F.coalesce("x", F.lit(0))}, lasts={"last": F.col("x")}, before={"prev": F.col("x")})
    assert laid.select("_stretch").distinct().count() > 1
    for g in ("hot", "a", None):
        n = s = 0
        last = prev = None
        mine = {x.i: x for x in got.where(F.col("g").eqNullSafe(F.lit(g))).collect()}
        for gg, i, x in rows:
            if gg != g:
                continue
            n, s, last = n + 1, s + (x or 0), x if x is not None else last
            assert (mine[i].n, mine[i].s, mine[i].last, mine[i].prev) == (n, s, last, prev)
            prev = x


def messages(spark, gaps, size=40):
    t, rows = 0, []
    for i, gap in enumerate(gaps):
        t += gap
        rows.append(("f", i + 1, i + 1, t, "x" * size))
    return spark.createDataFrame(rows, "source_file string, line_num int, rec_id bigint, t bigint, content string").withColumn("sent_at", F.timestamp_seconds("t"))


def test_gap_batches_and_packs(spark, many_stretches):
    r = random.Random(2)
    gaps = [r.choice([1, 2, 5, 6, -30, 400]) for _ in range(300)]
    start, size, want = 1, 0, {}
    for i, gap in enumerate(gaps, 1):
        if i > 1 and (gap > 5 or size >= 7):
            start, size = i, 0
        size += 1
        want[i] = start
    found = batching.gap_batches(messages(spark, gaps), 5.0, 7)
    assert {x.line_num: x.batch_line for x in found.collect()} == want
    sizes = batching.batch_sizes(found)
    order = sorted((x.batch_line, x.tokens) for x in sizes.collect())
    pack, total, packs = None, 0, {}
    for line, n in order:
        if pack is None or total + n > 60:
            pack, total = line, 0
        total += n
        packs[line] = pack
    assert {x.batch_line: x.pack_line for x in batching.token_packs(sizes, 60).collect()} == packs
    assert batching.token_packs(sizes.where("false"), 60).count() == 0


def test_gap_batches_keep_what_has_no_time_or_file(spark):
    rows = [("f", 1, 1, 0), ("f", 2, 2, None), ("f", 3, 3, 4), ("f", 4, 4, None), ("f", 5, 5, 40), ("g", 1, 6, None), ("g", 2, 7, 1), (None, 1, 8, 0), (None, 2, 9, 50)]
    df = spark.createDataFrame(rows, "source_file string, line_num int, rec_id bigint, t bigint").withColumns({"sent_at": F.timestamp_seconds("t"), "content": F.lit("abcd")})
    got = {x.rec_id: x.batch_line for x in batching.gap_batches(df, 5.0, 7).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1, 7: 1, 8: 1, 9: 2}
    assert batching.gap_batches(df.where("false")).count() == 0


def test_semantic_shift(spark):
    rows = [("s", i, i, x) for i, x in enumerate([0.9, 0.5, 0.9, 0.5, 0.5, 0.3, None, 0.9])]
    df = spark.createDataFrame(rows, "session string, at int, id int, similarity double")
    assert [x.id for x in batching.semantic_shift(df).where("shift").orderBy("id").collect()] == [3, 4, 5]
    assert [x.id for x in batching.semantic_shift(df, rule="three").where("shift").collect()] == [5]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_is_exact(spark, metric, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    r = np.random.default_rng(0)
    v = r.normal(size=(120, 4)).round(2)
    v[50:60] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [0.0] * 4), (902, [1.0])], "i bigint, e array<double>")
    rows = nearest.usable(df, "i", "e", 4)
    got = {(x.query_id, x["rank"]): x.id for x in nearest.knn(rows.where("id < 20"), rows, 6, 4, metric).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    score = -unit @ unit.T if metric == "cosine" else np.linalg.norm(v[:, None] - v[None], axis=2)
    for i in range(20):
        want = [j for j in np.lexsort((np.arange(120), score[i].round(9))) if j != i][:6]
        assert [got[i, k] for k in range(1, 7)] == want
    points = rows.where("id in (1, 2, 3, 4, 5, 6, 7, 8, 9)")
    best = {x.id: x.point_id for x in nearest.closest_points(rows, points, 1, 4).collect()}
    if metric == "cosine":
        assert all(best[i] == 1 + int(np.argmin(score[i, 1:10].round(9))) for i in range(120))
    assert nearest.knn(rows.where("false"), rows, 3, 4).count() == 0 == nearest.knn(rows.limit(1), rows.where("false"), 3, 4).count()


def test_knn_in_passes(spark):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(90, 4)))], "id bigint, v array<double>")
    one = sorted(tuple(x) for x in nearest.knn(rows, rows, 3, 4).collect())
    assert sorted(tuple(x) for x in nearest.knn(rows, rows, 3, 4, most=20).collect()) == one and len(one) == 270
    assert nearest.knn(rows.where("false"), rows, 3, 4).count() == 0 and nearest.knn(rows, rows.where("false"), 3, 4).count() == 0


def test_bm25_and_fusion(spark):
    rows = spark.createDataFrame([(1, "Cache cache index"), (2, "index"), (3, None), (4, "cold cache")], "id bigint, text string")
    queries = spark.createDataFrame([(1, "the CACHE, index!"), (2, "?!"), (3, "cache index"), (4, None)], "query_id bigint, text string")
    any_ = search.bm25(queries, rows, 5)
    assert {x.id for x in any_.where("query_id = 1").collect()} == {1, 2, 4} and any_.where("query_id in (2, 4)").count() == 0
    assert [x.id for x in search.bm25(queries, rows, 5, "and").where("query_id = 3").collect()] == [1]
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id bigint, rank int, id bigint")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "query_id bigint, rank int, id bigint")
    assert [x.id for x in search.rrf([a, b], 5).orderBy("rank").collect()] == [11, 10, 12] == [x.id for x in search.rrf([b, a], 5).orderBy("rank").collect()]
    assert [x.id for x in search.both_first(a, b, 5).orderBy("rank").collect()] == [11, 10, 12]
    shown = spark.createDataFrame([("The Cache, cached",)], "content string")
    assert search.highlight(shown, ["cache"]).first()[0] == "The [Cache], cached"


def test_walk_and_paths(spark):
    edges = [(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 9, 9)]
    rel = spark.createDataFrame([(*e, "x") for e in edges], "id bigint, from_id bigint, to_id bigint, relation_type string")
    seeds = spark.createDataFrame([(1,), (9,), (7,)], "id bigint")
    out = graph.walk(seeds, rel, 5, "out")
    assert {(x.seed, x.id): x.hop for x in out.collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (9, 9): 0, (7, 7): 0}
    assert {x.id: x.path for x in graph.paths(out).where("seed = 1").collect()}[4] == "1/2/3/4"
    assert {x.id: x.hop for x in graph.walk(seeds, rel, 1).where("seed = 1").collect()} == {1: 0, 2: 1, 3: 1}


def test_lifecycle(spark):
    ideas = spark.createDataFrame(
        [(1, "decision", None, 0, "2021-01-01"), (2, "context", False, 0, "2020-01-01"), (3, None, False, 9, "2021-01-01"), (4, "context", True, 0, "2020-01-01")],
        "id bigint, intent string, forgotten boolean, access_count int, d string",
    ).select("*", F.to_timestamp("d").alias("created_at"), F.lit(None).cast("timestamp").alias("message_time"), F.lit("s").alias("session"))
    now = F.lit("2021-01-01 12:00:00")
    assert {x.id: x.score for x in ideas.select("id", lifecycle.retention_score(now).alias("score")).collect()} == {1: 0.7, 2: 0.18, 3: 0.72, 4: 0.18}
    gone = lifecycle.forgettable(ideas, now, 0.5)
    assert [x.id for x in gone.collect()] == [2]
    assert {x.id: x.forgotten for x in lifecycle.mark_forgotten(ideas, gone).collect()} == {1: None, 2: True, 3: False, 4: True}
    wm = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.011)], "session string, idea_id bigint, activation double")
    assert lifecycle.decay(wm, 0.9).count() == 1
    rel = spark.createDataFrame([(1, 1, 2, "x"), (2, 1, 3, "x")], "id bigint, from_id bigint, to_id bigint, relation_type string")
    left, links = lifecycle.delete_cascade(ideas, rel, gone)
    assert left.count() == 3 and [x.id for x in links.collect()] == [2]


def test_upsert(spark):
    old = spark.createDataFrame([("f", 1, 1, "a"), ("f", 2, 2, "b"), (None, 1, 3, "c"), (None, 1, 4, "d")], "file string, line int, v int, x string")
    new = spark.createDataFrame([("f", 2, 1, "B"), ("f", 3, 1, "C"), ("f", 3, 2, "D")], "file string, line int, v int, x string")
    got = sorted((str(r.file), r.line, r.x) for r in records.upsert(old, new, ["file", "line"], ["v"]).collect())
    assert got == [("None", 1, "c"), ("None", 1, "d"), ("f", 1, "a"), ("f", 2, "B"), ("f", 3, "D")]


def test_sessions(spark):
    paths = ["/h/projects/-Users-a-my-app/x.jsonl", "/h/projects/plain/x.jsonl", "/tmp/log.v2.jsonl"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(records.session_of(F.col("p"))).collect()] == ["my-app", "plain", "log.v2"]
    known = spark.createDataFrame([("rad-Control",), ("other",)], "session string")
    assert records.match_session(known, "rad-control").first()[0] == "rad-Control"
    assert records.match_session(known, "x").count() == 0


def test_entities_and_plugins(spark):
    golden = spark.createDataFrame([("g1", "PostgreSQL"), ("g2", "Kubernetes"), ("g0", "kubernetes")], "id string, canonical_name string")
    names = spark.createDataFrame([("postgresql",), ("Postgressql",), ("Kubernets",), ("zzz",), (None,), ("",)], "name string")
    got = {x.name: x.golden_id for x in entities.link_mentions(names, golden).collect()}
    assert got == {"postgresql": "g1", "Postgressql": "g1", "Kubernets": "g0", "zzz": None, None: None, "": None}
    rows = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "content string")
    empty = spark.createDataFrame([], "hash string, embedding array<float>")
    cache = plugins.embed_missing(rows, empty, plugins.HashEmbedder(8))
    assert cache.count() == 2
    assert plugins.embed_missing(rows, cache.cache(), plugins.HashEmbedder(8)).count() == 0
    asked = spark.createDataFrame([(1, "Sum up.\n\nOne. Two.")], "id bigint, p string")
    assert plugins.complete_each(asked, "id", "p", plugins.FirstSentence()).first().answer == "One."


def test_export_and_import(spark, tmp_path):
    ts = "CAST('2021-01-01' AS timestamp)"
    spans = spark.sql(f"SELECT id, 's' session, parent parent_id, 'n' name, 'x' summary, 1 start_line, 2 end_line, 0 depth, {ts} created_at, CAST(1 AS bigint) topic_id, {ts} start_time, {ts} end_time FROM VALUES (1L, null), (2L, 1L), (3L, 77L) AS t(id, parent)")
    ideas = spark.createDataFrame([(1, 1, "f", 1, "s"), (2, 2, "f", 2, "s"), (3, None, "f", 3, "s")], "id bigint, span_id bigint, source_file string, source_line int, session string")
    rel = spark.createDataFrame([(1, 1, 2, "x"), (2, 1, 3, "x")], "id bigint, from_id bigint, to_id bigint, relation_type string")
    own = {"spans": spans, "ideas": ideas, "relations": rel}
    exchange.export(own, str(tmp_path), "s")
    back = exchange.load(spark, str(tmp_path), {k: v.schema for k, v in own.items()})
    assert all(sorted(map(str, back[k].collect())) == sorted(map(str, own[k].collect())) for k in own)
    none = {k: v.where("false") for k, v in own.items()}
    got = exchange.import_into(none, back)
    assert got["spans"].count() == 3 and got["ideas"].count() == 2 and got["relations"].count() == 1
    twice = exchange.import_into(got, back)
    assert twice["spans"].count() == 6 and twice["ideas"].count() == 2


def test_reparent(spark):
    from sparkloom.operators import context

    spans = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "id bigint, parent_id bigint, name string")
    moves = spark.createDataFrame([(1, 3), (3, 1)], "id bigint, parent_id bigint")
    moved, refused = context.reparent(spans, moves.where("id = 3"))
    assert {x.id: x.parent_id for x in moved.collect()} == {1: None, 2: 1, 3: 1} and refused.count() == 0
    moved, refused = context.reparent(spans, moves.where("id = 1"))
    assert {x.id: x.parent_id for x in moved.collect()} == {1: None, 2: 1, 3: 2} and [x.id for x in refused.collect()] == [1]
