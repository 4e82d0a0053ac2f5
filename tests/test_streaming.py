"""Streams give what the batch operators give."""

import json

from quillspark.operators.jobs import first_warnings
from quillspark.streaming import jobs

ROWS = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "error" if i % 2 else "view", i % 4, 1.0) for i in range(50)]
SCHEMA = "event_id long, ts timestamp, job long, kind string, msg long, value double"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_warnings_and_windows(spark, tmp_path):
    batch = spark.createDataFrame([(i, t, j, k, m, v) for i, t, j, k, m, v in ROWS], SCHEMA.replace("timestamp", "string")).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["f"]).col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = {(r.job, r.msg) for r in run(jobs.warnings_once(stream), "warned").collect()}
    assert got == {(r.job, r.msg) for r in first_warnings(batch).collect()}
    counts = {(r.start, r.kind): r.n for r in run(jobs.windowed(stream), "counted", "complete").collect()}
    assert counts == {(r.start, r.kind): r.n for r in jobs.windowed(batch).collect()} and sum(counts.values()) == 50


def test_jsonl(spark):
    lines = [json.dumps({"t": 1.5, "kind": "stage", "stage": "layout"}), "broken {", json.dumps({"kind": "warning", "msg": "m"})]
    got = jobs.parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.kind, r.stage, r.msg) for r in got] == [("stage", "layout", None), ("warning", None, "m")]


def feed(spark, tmp_path, name, schema, parts, fn):
    """The stream's rows when each part arrives as its own micro-batch."""
    folder = tmp_path / name
    folder.mkdir()
    q = fn(spark.readStream.schema(schema).parquet(str(folder))).writeStream.format("memory").queryName(name).outputMode("append").start()
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_full_batches(spark, tmp_path):
    from quillspark.streaming import stateful

    schema = "doc_id long, i int, n int, last boolean"
    parts = [[(1, 0, 20, False), (1, 1, 20, False), (2, 0, 40, False)], [(1, 2, 10, False), (1, 3, 3, False)], [(1, 4, None, True), (2, 1, 1, True)]]
    got = [(r.doc_id, r.chars, r.units, r["items"]) for r in feed(spark, tmp_path, "packed", schema, parts, lambda s: stateful.full_batches(s, 30, 10))]
    assert sorted(got) == [(1, 23, 2, "1,3"), (1, 30, 2, "0,2"), (2, 1, 1, "1"), (2, 40, 1, "0")]


def test_joined_pages(spark, tmp_path):
    from quillspark.streaming import stateful

    schema = "doc_id long, pno int, pi int, text string, last boolean"
    parts = [[(1, 0, 0, "A head.", False), (1, 0, 1, "An open sen-", False)], [(1, 1, 0, "tence goes on", False)], [(1, 2, 0, "and ends.", False), (1, 2, 1, "then none", False)], [(1, 3, 0, "Upper", True)]]
    got = [(r.pno, r.pi, r.text) for r in feed(spark, tmp_path, "pages", schema, parts, stateful.joined_pages)]
    assert got == [(0, 0, "A head."), (0, 1, "An open sentence goes on\nand ends."), (2, 1, "then none"), (3, 0, "Upper")]


def test_control(spark, tmp_path):
    from quillspark.operators.jobs import control_states
    from quillspark.streaming import stateful

    schema = "job long, event_id long, cmd string"
    rows = [(i % 3, i, ("pause", "resume", None, "cancel", "odd")[i * 7 % 5]) for i in range(12)]
    batch = {(r.job, r.event_id): r.state for r in control_states(spark.createDataFrame(rows, schema)).collect()}
    got = {(r.job, r.event_id): r.state for r in feed(spark, tmp_path, "states", schema, [rows[:5], rows[5:]], stateful.control)}
    assert got == batch and "cancelled" in got.values()
