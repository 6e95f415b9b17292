from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import questions as q
from sparkloom.functions import text as tx
from sparkloom.functions.times import instant, period_key


def apply(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_intents(spark):
    cases = {
        "We decided to keep SQLite": "decision", "using WAL mode": "decision", "Fixed by a restart": "solution", "It works now": "solution", "The issue is with locks": "problem",
        "Tests are failing": "problem", "Turns out it was DNS": "conclusion", "Need to add an index": "todo", "Where is it": "question", "Is this right?": "question", "A plain note": "context", "": "context",
    }
    assert apply(spark, cases, tx.classify_intent) == list(cases.values())
    assert apply(spark, [None], tx.classify_intent) == ["context"]


def test_filter_reasons(spark):
    cases = {
        "": "empty", "    ": "empty", "ok": "too_short", "Hello! How can I assist today?": "greeting_response", "Running the whole test suite again": "tool_narration",
        "[Request interrupted by user]": "system_message", "I'm ready to help with the project": "warmup", "please run it with the other flag": "short_instruction",
        "Let me check the configuration file now": "preamble", "Let me check it because the reason is unclear": None, "We keep one writer, as two lose updates": None,
    }
    assert apply(spark, cases, tx.filter_reason) == list(cases.values())
    assert apply(spark, ["The writer holds one lock."], lambda c: tx.filter_reason(c, F.lit(True))) == ["short_tool_intro"]


def test_confidence(spark):
    got = apply(spark, ["maybe it could", "we must do it", "plain", "perhaps it will"], lambda c: tx.assess_confidence(c, F.lit("decision")))
    assert got == [0.65, 0.9, 0.8, 0.75]


def test_names(spark):
    assert apply(spark, ["**okay, let's fix** the `cache`", "# Now design", "x" * 90, "word " * 30], tx.clean_topic_name)[:2] == ["Fix the cache", "Design"]
    assert [len(x) for x in apply(spark, ["x" * 90, "word " * 30], tx.clean_topic_name)] == [80, 79]
    assert apply(spark, ["Let's  plan   things!?", "session start: A"], tx.canonical_topic) == ["plan things", ": a"]
    assert apply(spark, ["abc", "the thing", "A real topic", None], tx.bad_topic_name) == [True, True, False, True]


def test_overlap_and_entities(spark):
    df = spark.createDataFrame([("the queue writer failed", "a writer for the queue"), ("queue", "queue"), (None, "queue writer")], "a string, b string")
    assert [r[0] for r in df.select(tx.content_overlap(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    got = apply(spark, ["Postgres and src/app.py with rate limiting; cargo"], tx.extract_entities)[0]
    assert {(e.name, e.type) for e in got} >= {("PostgreSQL", "technology"), ("src/app.py", "file"), ("rate limiting", "concept"), ("Go", "technology")}
    bounded = apply(spark, ["Postgres and cargo"], lambda c: tx.extract_entities(c, True))[0]
    assert {e.name for e in bounded} == {"PostgreSQL"}


def test_string_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "a"), ("Abc", "aBC"), (None, "a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(tx.string_similarity("a", "b")).collect()] == [round(8 / 13, 4), 0.0, 1.0, 0.0]


def test_instants(spark):
    cases = {
        "2021-03-01T00:00:00Z": 1614556800000000, "2021-03-01 01:00:00.5+01:00": 1614556800500000, "2021-03-01T00:00:00": 1614556800000000, "1614556800000": 1614556800000000,
        "2021-02-30T00:00:00Z": None, "T10:15:00Z": None, "2021-03-01": None, "n/a": None, "": None, "0000-00-00T00:00:00Z": None, "2021-03-01T00:00:00.1234567-0100": 1614560400123456,
    }
    assert apply(spark, cases, instant) == list(cases.values())
    assert apply(spark, ["2024-12-30 00:00:00"], lambda c: period_key(c.cast("timestamp"), "week")) == ["2024-W01"]


def period(spark, phrase, now):
    df = spark.createDataFrame([(phrase, now)], "p string, now timestamp_ntz")
    return tuple(df.select(q.period_of(F.col("p"), F.col("now").cast("timestamp")).alias("r")).selectExpr("CAST(r.since AS timestamp_ntz)", "CAST(r.until AS timestamp_ntz)").first())


def test_questions(spark):
    now = datetime(2024, 3, 6, 15, 30)
    assert period(spark, "since tuesday", now)[0] == datetime(2024, 3, 5)
    assert period(spark, "since wednesday", now)[0] == datetime(2024, 2, 28)
    assert period(spark, "since jan 5", now)[0] == datetime(2024, 1, 5)
    assert period(spark, "since april", now)[0] == datetime(2023, 4, 1)
    assert period(spark, "since feb 29", datetime(2025, 3, 1))[0] == datetime(2024, 2, 29)
    assert period(spark, "yesterday", now) == (datetime(2024, 3, 5), datetime(2024, 3, 6))
    assert period(spark, "2m", now)[0] == datetime(2024, 1, 6, 15, 30)
    texts = ["decisions about caching", "relationship between auth and cache", "index rebuild and write queue", "salt and pepper", "How tokens relate to cost", "auth and its connection with login", None, "", "Recent decisions on Redis config"]
    rows = {x.query_id: x for x in q.analyzed(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), F.lit("2024-03-06 15:30:00").cast("timestamp")).collect()}
    assert rows[0].kind == "intent_scoped" and rows[0].intent == "decision" and rows[0].parts == ["caching"]
    assert rows[1].parts == ["auth", "cache"] and rows[1].kind == rows[4].kind == rows[5].kind == "relation" and rows[4].parts == ["tokens", "cost"] and rows[5].parts == ["auth", "login"]
    assert rows[2].kind == "conjunction" and [rows[i].kind for i in (3, 6, 7)] == ["simple"] * 3
    assert rows[8].since == datetime(2024, 2, 28, 15, 30) and rows[8].intent == "decision" and rows[8].technologies == ["redis"] and "settings" in rows[8].terms and rows[0].since is None


@pytest.mark.parametrize("phrase", ["", "since", "since nothing", "gibberish"])
def test_unknown_time_is_a_week(spark, phrase):
    now = datetime(2024, 3, 6)
    assert period(spark, phrase, now) == (datetime(2024, 2, 28), now)


def test_met_is_any_of(spark):
    texts = ["", "the decision is x", "so we decided", "we decided", "lets work on it", "let's work on it", "next lets go", "next, let's", "is this?", "why\nnot", None, "it's not working", "okay, lets"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (*tx.INTENTS.values(), tx.SHIFTS, tx.SUBTOPICS, tx.RETURNS, tx.REVIEW_NAMES, tx.PREAMBLES):
        assert df.where(~F.col("t").rlike(tx.any_of(patterns)).eqNullSafe(tx.met(F.col("t"), patterns))).count() == 0
    assert sorted(tx.spelled("le'?s a,?")) == sorted(["le's a,", "le's a", "les a,", "les a"]) and tx.spelled("a.b") is None and tx.spelled("a?b*") is None
