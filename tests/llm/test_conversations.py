import random

import pytest
from pyspark.sql import Row

from sparkloom.llm import conversations as cv

SCHEMA = "rec_id bigint, session string, source_file string, line_num int, type string, timestamp string, message struct<role string, content string>, tool_use_result string, damaged string, at int, record_text string"


def record(i, session="s", kind="user", at=None, content="text", role="=", tool=None, file="f", line=None):
    message = None if content == "no message" else Row(role=kind if role == "=" else role, content=content)
    return (i, session, file, i if line is None else line, kind, f"2021-03-01T00:00:{i:02d}Z" if at is None else at, message, tool, "clash", 1, "clash")


def found(spark, rows):
    return {(x.session, x.opener_rec_id, x.step, x.rec_id) for x in cv.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


U, A = "user", "assistant"


def test_whole_sessions(spark):
    rows = [record(1, "a"), record(2, "a", A), record(3, "a", A), record(4, "a"), record(5, "a", A, content='[{"type":"text","text":"x"}]')]
    rows += [record(6, "b"), record(7, "b")]  # unanswered
    rows += [record(8, "c", A), record(9, "c", A)]  # begins with the assistant
    rows += [record(10, "d"), record(11, "d"), record(12, "d", A)]  # two questions in a row
    rows += [record(13, "e"), record(14, "e", A, at="n/a")]  # unreadable time
    rows += [record(15, "f"), record(16, "f", A, role="user")]  # another speaker
    rows += [record(17, "g"), record(18, "g", A), record(19, "g", A, content="[{")]  # damaged
    rows += [record(20, None), record(21, None, A)]
    rows += [record(22, "h"), record(23, "h", A, role=" ASSISTANT\n"), record(24, "h", content="  "), record(25, "h", content=None), record(26, "h", content="no message"), record(27, "h", content="[]"), record(28, "h", "system"), record(29, "h", tool="{}", content="[{"), record(30, "h", A, role=" ")]
    want = {("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 1, 2, 3), ("a", 4, 0, 4), ("a", 4, 1, 5), ("h", 22, 0, 22), ("h", 22, 1, 23), ("h", 22, 2, 30)}
    assert found(spark, rows) == want
    assert found(spark, []) == set()
    dropped = cv.dropped_sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.session for x in dropped} == set("bcdefg")
    texts = {x.rec_id: (x.role, x.text) for x in cv.conversation_turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts[5] == (A, "x") and texts[1] == (U, "text") and len(texts) == 8


def test_order_and_redelivery(spark):
    t = "2021-03-01T00:00:00Z"
    rows = [record(1, kind=A, at=t, file="b", line=1), record(2, at="1614556800000", file="a", line=2), record(3, at="2021-03-01 01:00:00+01:00", file="a", line=2), record(4, at=t, file="a", line=3, kind=A)]
    assert found(spark, rows) == {("s", 2, 0, 2), ("s", 2, 1, 4), ("s", 2, 2, 1)}


def test_long_sessions_in_stretches(spark, many_stretches):
    r = random.Random(4)
    rows, want, n = [], set(), 0
    for session, bad in (("hot", False), ("x", False), ("broken", True), ("y", False)):
        opener = step = 0
        before = A
        size = 400 if session == "hot" else 30
        for k in range(size):
            n += 1
            kind = A if k == size - 1 else U if before == A and (k == 0 or r.random() < 0.3) or bad and k in (10, 11) else A
            before = kind
            opener, step = (n, 0) if kind == U else (opener, step + 1)
            rows.append(record(n, session, kind, at=str(1614556800000 + n * 1000)))
            if not bad:
                want.add((session, opener, step, n))
    r.shuffle(rows)
    assert found(spark, rows) == want


@pytest.mark.parametrize("op, want", [("create", "a"), ("CREATE,edit", "b"), ("create,edit,retry,edit", "d"), ("create,edit,delete", None), ("create,delete,edit", "c"), ("create,retry", "a"), ("retry", "a"), ("create,delete,create", None)])
def test_fold_log(spark, op, want):
    rows = [("k", v, o, "abcd"[v]) for v, o in enumerate(op.split(","))]
    df = spark.createDataFrame(rows, "key string, version int, op string, x string")
    assert [r.x for r in cv.fold_log(df, ["key"], "version", "op").collect()] == ([want] if want else [])
    nameless = spark.createDataFrame([(None, 1, "create", "p"), (None, 2, "create", "q")], df.schema)
    assert cv.fold_log(nameless, ["key"], "version", "op").count() == 2
