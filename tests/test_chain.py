"""From texts to judged answers, retries over true routes, and the induction queue."""

from pyspark.sql import functions as F

from lumenfold.functions import fidelity, seams
from lumenfold.operators import chain, memory
from lumenfold.streaming import induction

EPISODE = "Deployed API_SERVER to node alpha.\n\n  Restarted Worker on node beta because disk was full. \nDeployed API_SERVER to node alpha.\nVerified src/app.py returns HTTP 200."


def asked(spark, rows):
    return spark.createDataFrame(rows, "session string, query_id int, query string, expected string").withColumn("vector", fidelity.hashed_encoding(F.col("query")))


def test_construct_retrieve_answer_judge(spark):
    hot, cold = chain.construct(spark.createDataFrame([("e1", EPISODE), ("e1b", None)], "session string, text string"))
    assert [(r["id"], r["text"][:9]) for r in cold.orderBy("id").collect()] == [("e1:0", "Deployed "), ("e1:1", "Restarted"), ("e1:2", "Deployed "), ("e1:3", "Verified ")]
    assert {r["id"] for r in hot.collect()} == {"e1:0", "e1:1", "e1:3"}  # the repeated line is cold only
    questions = asked(spark, [("e1", 1, "why was Worker restarted on node beta because of disk", "disk was full"), ("e1", 2, "what is src/app.py", "HTTP 200"), ("e1", 3, "why was Worker restarted on node beta because of disk", "disk was full"), ("e1", 4, "", "zzz")])
    made, record = chain.contexts(questions, hot, cold)
    got = {r["query_id"]: r for r in made.collect()}
    assert {q: (r["qa_type"], r["how"], r["source_id"]) for q, r in got.items()} == {1: ("causal", "miss", 1), 2: ("entity", "miss", 2), 3: ("causal", "uuid", 1), 4: ("unknown", "miss", 4)}
    assert got[3]["context"] == got[1]["context"] and len(got[2]["context"].split("\n")) == 3  # an entity question takes three
    assert {r["call"] for r in record.collect()} == {1}  # enriched questions that missed
    scores = {r["query_id"]: r["score"] for r in chain.judged(questions, made, lambda q, c: c, lambda a, e: seams.substring_judge(a, e)).collect()}
    assert scores[1] == scores[3] and scores[4] == 0.0


def test_retries_go_through_other_routes(spark):
    hot = spark.createDataFrame([("a", "red", [1.0, 0.0])], "id string, text string, vector array<double>")
    cold = spark.createDataFrame([("a", "red"), ("b", "blue whale"), ("c", "whale")], "id string, text string")
    questions = spark.createDataFrame([(1, "blue whale", [1.0, 0.0]), (2, "red", [1.0, 0.0])], "query_id int, query string, vector array<double>")
    wanted = spark.createDataFrame([(1, "b"), (2, "a")], "query_id int, id string").withColumn("ok", F.lit(1.0))
    sure = lambda found: found.join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.max("ok").alias("confidence"))
    got = memory.retry(questions, memory.finder(hot, cold, None), sure, 1, "hot_cache").collect()
    assert {(r["query_id"], r["attempt"], r["route"], r["confidence"]) for r in got} == {(1, 3, "cold_storage", 1.0), (2, 1, "hot_cache", 1.0)}


def test_each_artifact_is_induced_once(spark, tmp_path):
    queue, at, out = (str(tmp_path / n) for n in ("queue", "at", "out"))
    seen = []
    keep = lambda frame, batch: seen.extend(r["artifact_id"] for r in frame.collect())
    make = lambda ids: spark.createDataFrame([(i, f"name: x{i}\nsize: {i}") for i in ids], "artifact_id long, artifact string")
    induction.enqueue(make(range(6)), queue)
    induction.drain(spark, queue, at, keep)
    induction.drain(spark, queue, at, keep)  # nothing new
    induction.enqueue(make(range(6, 14)), queue)
    induction.drain(spark, queue, at, keep)
    assert sorted(seen) == list(range(14))
    induction.drain(spark, queue, at + "2", induction.induce_to(out))
    assert {(r["field"], r["required"]) for r in spark.read.parquet(out).collect()} == {("name", True), ("size", True)}
