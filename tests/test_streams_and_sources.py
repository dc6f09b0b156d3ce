import json

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import fidelity as V
from lumenfold.operators import gate
from lumenfold.sources import sessions
from lumenfold.streaming import gate as stream


def test_stream_decides_as_the_batch(spark, tmp_path):
    rows = [("s", i, t) for i, t in enumerate(["Alpha 1", "Alpha 1", "plain words", "plain words", "Beta"])]
    schema = "session_id string, seq long, text string"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    q = stream.stream_gate(source).writeStream.format("memory").queryName("gate_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session"], r["seq"]): r["novel"] for r in spark.table("gate_out").collect()}
    batch = gate.novelty_gate(spark.createDataFrame(rows, schema).withColumn("vector", V.hashed_encoding(F.col("text"))))
    assert got == {(r["session"], r["seq"]): r["novel"] for r in batch.collect()}


def test_windows_and_events(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id int, ts string")
    assert sorted(r["events"] for r in stream.session_windows(rows).collect()) == [1, 2]
    events = stream.replay_events(spark.createDataFrame([("s", 1, True)], "session string, seq int, novel boolean"))
    assert [r["type"] for r in events.orderBy("step").collect()] == ["start", "ingest", "complete"]


def test_episodes(spark, tmp_path):
    row = {"episode_id": "e1", "domain": "web", "trajectory": json.dumps([{"turn_idx": 0, "action": "click", "observation": "x" * 900}, {"turn_idx": 1, "action": "", "observation": "ok"}]), "qa_pairs": "[]"}
    (tmp_path / "e.jsonl").write_text(json.dumps(row) + "\n")
    got = sessions.episode_segments(sessions.episodes(spark, str(tmp_path / "e.jsonl"), "all")).orderBy("turn").collect()
    assert [(r["turn"], r["role"], len(r["text"])) for r in got] == [(0, "assistant", 5), (1, "tool", 800), (3, "tool", 2)]
    assert sessions.episodes(spark, str(tmp_path / "e.jsonl"), "other").isEmpty()
    with pytest.raises(IndexError):
        sessions.episode_at(sessions.episodes(spark, str(tmp_path / "e.jsonl")), 5)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5)], "text string, _cos_sim double")
    sessions.write_pairs(rows, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).columns == ["text"]
    first, second = sessions.write_summary(rows, str(tmp_path / "s")), sessions.write_summary(rows, str(tmp_path / "s"))
    assert first != second
    sessions.append(rows, str(tmp_path / "log"))
    sessions.append(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_replay(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"text": "a", "delay_seconds": 1}\n\n{"text": "b", "delay_seconds": 2}\n')
    assert sessions.replay(spark, str(tmp_path / "r.jsonl")).count() == 2


def test_replay_events_of_all_kinds(spark):
    decided = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, True)], "session string, seq long, novel boolean")
    late = spark.createDataFrame([("a", 1)], "session string, seq long")
    stale = spark.createDataFrame([("a", 1, 0)], "session string, seq long, stale_seq long")
    rows = stream.replay_events(decided, stale, late, totals=True).where("session = 'a'").orderBy("seq", "step").collect()
    assert [(r["seq"], r["type"], r["action"]) for r in rows] == [(0, "start", "hot"), (0, "ingest", "hot"), (0, "complete", "hot"), (1, "start", "cold_only"), (1, "ingest", "cold_only"), (1, "contradiction", "stale 0"), (1, "timeout", "late"), (1, "stats", "1 of 2")]


def test_event_time_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(stream, "BLOCK_LINES", 3)
    rows = spark.createDataFrame([(i, 1.5) for i in range(10)], "line long, delay_seconds double")
    got = stream.with_event_time(rows, "2024-01-01 00:00:00").selectExpr("line", "cast(event_time as double) - cast(timestamp'2024-01-01 00:00:00' as double) as t").orderBy("line").collect()
    assert [round(r["t"], 6) for r in got] == [1.5 * (i + 1) for i in range(10)]
