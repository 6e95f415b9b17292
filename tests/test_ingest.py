import json

from pyspark.sql import functions as F

from sparkloom.functions.times import instant
from sparkloom.operators import batching
from sparkloom.sources import transcripts
from sparkloom.streaming import ingest


def line(i, text, kind="user"):
    return json.dumps({"type": kind, "timestamp": f"2021-03-01T00:{i:02d}:00Z", "message": {"role": kind, "content": text}})


def folder(tmp_path):
    root = tmp_path / "projects" / "-home-a-app"
    (root / "subagents").mkdir(parents=True)
    (root / "subagents" / "x.jsonl").write_text(line(1, "helper") + "\n")
    return root


def test_batch_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transcripts, "SLICE", 100)
    root = folder(tmp_path)
    blocks = [{"type": "text", "text": "ü"}]
    text = "\n".join([line(1, "one"), "", "not json", line(2, blocks), "[1]", line(3, "x" * 300), '{"half": '])
    (root / "a.jsonl").write_text(text)
    rows = transcripts.records(transcripts.read_transcripts(spark, str(tmp_path))).orderBy("byte_start").collect()
    assert [(r.message.content[:20], r.session) for r in rows] == [("one", "app"), (json.dumps(blocks, separators=(",", ":"), ensure_ascii=False)[:20], "app"), ("x" * 20, "app")]
    assert [r.byte_start for r in rows] == [text.encode().index(x.encode()) for x in (line(1, "one"), line(2, blocks), line(3, "x" * 300))]


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    root = folder(tmp_path)
    file = root / "a.jsonl"
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        rows = transcripts.records(transcripts.stream_transcripts(spark, str(tmp_path / "projects")))
        ingest.write_epochs(rows.select("source_file", "byte_start", F.col("message.content").alias("content")), out, check).awaitTermination(120)
        return sorted(r.content for r in spark.read.parquet(out).collect())

    whole = line(2, "two")
    file.write_text(line(1, "one") + "\n" + whole[:20])
    assert run() == ["one"]
    with file.open("a") as f:
        f.write(whole[20:] + "\n" + line(3, "three") + "\n")
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    root = folder(tmp_path)
    file = root / "a.jsonl"
    texts = ["start", "let's dig into locks", "more", "stepping back, fine", "let's switch to tests", "end"]
    minutes = [0, 1, 2, 9, 10, 11]
    outs = {k: (str(tmp_path / f"out-{k}"), str(tmp_path / f"check-{k}")) for k in ("gaps", "spans")}

    def run():
        rows = transcripts.records(transcripts.stream_transcripts(spark, str(tmp_path / "projects")))
        m = rows.select("source_file", "byte_start", instant(F.col("timestamp")).alias("at"), F.col("message.content").alias("content"))
        ingest.write_epochs(ingest.stream_gap_batches(m, 300.0, 2), *outs["gaps"]).awaitTermination(180)
        ingest.write_epochs(ingest.stream_spans(m), *outs["spans"]).awaitTermination(180)

    lines = [line(i, t) for i, t in zip(minutes, texts, strict=True)]
    for part in (lines[:2], lines[2:]):
        with file.open("a") as f:
            f.write("\n".join(part) + "\n")
        run()
    rows = transcripts.records(transcripts.read_transcripts(spark, str(tmp_path / "projects")))
    m = rows.select("source_file", F.col("byte_start").alias("line_num"), F.col("byte_start").alias("rec_id"), F.timestamp_micros(instant(F.col("timestamp"))).alias("sent_at"), F.col("message.content").alias("content"))
    want = {(r.line_num, r.batch_line) for r in batching.gap_batches(m, 300.0, 2).collect()}
    assert {(r.byte_start, r.batch_start) for r in spark.read.parquet(outs["gaps"][0]).collect()} == want
    got = [(r.depth, r.span, r.parent) for r in spark.read.parquet(outs["spans"][0]).orderBy("byte_start").collect()]
    assert [g[0] for g in got] == [0, 1, 1, 0, 0, 0]
    assert got[1][2] == got[0][1] == got[3][1] and got[4][1] != got[0][1] == got[0][1] and got[5][1] == got[4][1]


def test_windowed_activity(spark):
    rows = spark.createDataFrame([("s", 0), ("s", 60), ("s", 1000), (None, 0)], "session string, t long").withColumn("sent_at", F.timestamp_seconds("t"))
    assert sorted(r.n for r in ingest.windowed_activity(rows).collect()) == [1, 1, 2]
