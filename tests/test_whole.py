"""Cases where a fixed cut would lose rows, which the given tables don't have."""

import numpy as np

from sparkloom.operators import records
from sparkloom.plans.registry import QUERIES


def test_similar_ideas_of_an_idea_with_many_relations(spark, tmp_path):
    angle = np.linspace(0, 1.5, 120)
    v = np.zeros((120, 64), np.float32)
    v[:, 0], v[:, 1] = np.cos(angle), np.sin(angle)
    ids = [0, *[i for i in range(1, 122) if i % 50]]  # of these 0 alone is a query
    spark.createDataFrame([(i, x.tolist(), False) for i, x in zip(ids, v, strict=True)], "id bigint, embedding array<float>, forgotten boolean").write.parquet(f"{tmp_path}/ideas.parquet")
    related = [(0, i) if i % 2 else (i, 0) for i in ids[1:46]] * 2
    spark.createDataFrame(related, "from_id bigint, to_id bigint").write.parquet(f"{tmp_path}/relations.parquet")
    got = [(x.query_id, x.rank, x.id) for x in QUERIES["similar_ideas"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(0, n + 1, i) for n, i in enumerate(ids[46:56])]


def test_paths_of_six_hops(spark, tmp_path):
    spark.createDataFrame([(0,), (1,)], "id bigint").write.parquet(f"{tmp_path}/ideas.parquet")
    spark.createDataFrame([(i, i + 1) if i % 2 else (i + 1, i) for i in range(8)], "from_id bigint, to_id bigint").write.parquet(f"{tmp_path}/relations.parquet")
    got = [(x.seed, x.id, x.hop, x.path) for x in QUERIES["find_path_far"](spark, str(tmp_path)).orderBy("hop").collect()]
    assert got == [(0, n, n, "/".join(map(str, range(n + 1)))) for n in range(7)]


def test_related_topic_by_its_one_close_span(spark, tmp_path):
    at = np.eye(64, dtype=np.float32)
    # Topic 1 lies on axis 0. Topic 2 has one span there and its mean far off; topic 3 is unlike.
    vectors = {10: (1, at[0]), 20: (2, at[0]), 21: (2, at[1]), 22: (2, at[1]), 23: (2, at[2]), 30: (3, at[3])}
    spans = [(i, t) for i, (t, _) in vectors.items()]
    ideas = [(i, i, v.tolist(), False) for i, (_, v) in vectors.items()]
    rest = "end_time timestamp, end_line int, depth int, start_time timestamp, created_at timestamp, start_line int, name string, summary string, session string, parent_id bigint"
    spark.createDataFrame([(*s, *[None] * 10) for s in spans], f"id bigint, topic_id bigint, {rest}").write.parquet(f"{tmp_path}/spans.parquet")
    spark.createDataFrame(ideas, "id bigint, span_id bigint, embedding array<float>, forgotten boolean").write.parquet(f"{tmp_path}/ideas.parquet")
    got = [tuple(x) for x in QUERIES["related_topics_by_span"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0)]


def test_similar_names_with_other_last_words(spark, tmp_path):
    names = ["vector index", "vector indexes", "Vector indxe", "cache", "cahce", "caches 2", "", None, "rate limit", "rate limits", "limit rate", "a", "A"]
    spark.createDataFrame(list(enumerate(names)), "id bigint, canonical_name string").write.parquet(f"{tmp_path}/topics.parquet")

    def alike(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row = next_row(row, c, y)
        return round(2 * row[-1] / (len(x) + len(y)), 6)

    def next_row(row, c, y):
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        return new

    low = [(i, n.lower()) for i, n in enumerate(names) if n]
    want = {(i, j, s) for i, x in low for j, y in low if i < j and (s := alike(x, y)) >= 0.8}
    got = {tuple(x) for x in QUERIES["similar_names"](spark, str(tmp_path)).collect()}
    assert got == want and (0, 1) in {x[:2] for x in want}


def test_a_hot_file_of_messages_is_not_one_window(spark):
    rows = spark.createDataFrame([("f", i, i) for i in range(1, 6)], "source_file string, rec_id bigint, line_num int")
    found = records.neighbours_in_file(rows, 1, 1)
    assert sorted(map(tuple, found.collect())) == sorted((i, i + d, d) for i in range(1, 6) for d in (-1, 1) if 1 <= i + d <= 5)
    # Windows that aren't cut into stretches go by the file alone.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    alone = [x for x in plan.splitlines() if "row_number()" in x and "_stretch" not in x]
    assert not alone
