"""Changed indexes against rebuilt ones, nearest vectors against all pairs, and batches of routed questions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import graph, lexical, memory, vectors

WORDS = ["red", "fox", "lake", "stone", "lamp", "tree", "road", "bird"]


def found(rows):
    return {(r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_changed_index_as_rebuilt(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(WORDS[: rng.choice([3, 8])]) for _ in range(rng.randint(1, 12)))])
    docs = {i: text() for i in range(30)}
    asked = spark.createDataFrame([(1, "red fox"), (2, "lamp tree tree"), (3, "nothing")], "query_id int, query string")
    base = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    index = lexical.build(base)
    assert found(index.search(asked, 5)) == found(lexical.bm25_topk(asked, base, 5))
    at = 0
    for step in range(3):
        changes = []
        for _ in range(60):
            i, op, t = rng.randint(0, 45), rng.choice(["add", "remove"]), text()
            changes.append((i, at, op, t))
            at += 1
            if op == "remove":
                docs.pop(i, None)
            else:
                docs.setdefault(i, t)
        rows = spark.createDataFrame([*changes, (None, 1, "add", "red"), (3, 5, "other", "red")], "id long, at int, op string, text string").repartition(3)
        index = lexical.change(index, rows)
        if step == 1:
            index = lexical.compact(index)
            assert index.gone is None
        now = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        assert index.documents().count() == len(docs)
        assert found(index.search(asked, 5)) == found(lexical.bm25_topk(asked, now, 5))


def test_terms_beyond_the_bound_meet_by_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red {WORDS[i % 8]} x{i}") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red lake"), (2, "bird")], "query_id int, query string")
    some = found(lexical.bm25_topk(asked, docs, 4))
    monkeypatch.setattr(lexical, "MOST_TERMS", 1)
    assert found(lexical.bm25_topk(asked, docs, 4)) == some and len(some) == 8
    assert lexical.bm25_topk(asked.limit(0), docs, 4).count() == 0


def test_documents_meet_all_queries_in_their_own_row(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(WORDS[:4]) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (3, "red"), (3, texts[3][1]), (99, None)], "doc_id long, text string").repartition(5)  # an id that repeats
    asked = spark.createDataFrame([(1, "red fox fox"), (2, "lake"), (None, "stone"), (4, "no word of it")], "query_id int, query string")
    rows = lexical.bm25_topk(asked, docs, 4)
    assert "SortMergeJoin" not in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
    got = found(rows)
    monkeypatch.setattr(lexical, "MOST_WEIGHTS", 0)
    assert found(lexical.bm25_topk(asked, docs, 4)) == got and len(got) == 12


@pytest.mark.parametrize(("block", "chunk"), [(512, 8192), (7, 13)])
def test_nearest_as_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03}", x.tolist()) for i, x in enumerate(rng.integers(-2, 3, (150, 4)).astype(float))]
    df = spark.createDataFrame([*rows, ("null", None), ("empty", []), ("short", [1.0])], "vec_id string, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.cosine_topk(df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), df, 3).collect()}
    for i, v in rows:
        order = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i)[:3]
        assert [got[i, n + 1] for n in range(3)] == [(j, -s) for s, j in order]
    assert len(got) == 450


def test_copies_of_vectors_grow_with_the_rows(spark, monkeypatch):
    assert vectors.parts(100_000, 64) == vectors.parts(600_000, 64) == vectors.SIDE
    assert vectors.parts(60_000_000, 64) * vectors.MOST_VALUES >= 60_000_000 * 64  # what a task holds is bounded
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "SIDE", 3)
    copies = [(i, [float(i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame([*copies, (60, [float("nan"), 1.0])], "vec_id int, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.cosine_topk(df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), df, 2).collect()}
    for i, v in copies:
        order = sorted((-float(np.dot(v, w)), j) for j, w in copies if j != i)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in order]
    assert len(got) == 120


def test_batch_of_routes_and_what_it_records(spark):
    hot = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "red lake", [0.8, 0.6]), (3, "lamp", [0.0, 1.0]), (4, "fox lamp fox", None)], "id int, text string, vector array<double>")
    cold = spark.createDataFrame([(1, "red fox"), (2, "red lake"), (3, "lamp"), (4, "fox lamp fox"), (5, "stone")], "id int, text string")
    questions = [(10, "fox", [1.0, 0.0], "enriched"), (11, "fox", [1.0, 0.0], "hot_cache"), (12, "stone", [1.0, 0.0], "cold_storage"), (13, "none of it", None, "hot_cache"), (14, None, None, "enriched")]
    asked = spark.createDataFrame(questions, "query_id int, query string, vector array<double>, route string")
    edges = spark.createDataFrame([(3, 4, 9, 0.8), (1, 5, 1, 0.3), (1, 9, 2, 0.5)], "a int, b int, count long, weight double")
    rows, record = memory.retrieve_batch(asked, hot, cold, edges, k=4, wide=1)
    got = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault((r["query_id"], r["route"]), []).append((r["id"], r["how"]))
    assert got[10, "enriched"] == [(1, "hot"), (4, "cold"), (5, "cold")]  # by vector, by words, the neighbour of 1 (9 is in no store)
    assert got[11, "hot_cache"] == [(1, "hot")] and got[12, "cold_storage"] == [(5, "ranked")]
    assert [h for _, h in got[13, "hot_cache"]] == ["first"] * 4 and [h for _, h in got[14, "enriched"]] == ["first"] * 4
    assert {tuple(r) for r in record.collect()} == {(10, 1, True), (10, 4, True)}
    assert [tuple(r) for r in graph.replay(record, cold="cold").collect()] == [(1, 4, 3, 0.6)]


def test_cold_fallback_reads_rows_in_slices(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('alpha beta', id) AS text")
    asked = spark.createDataFrame([(1, "lph"), (2, "zzz")], "query_id int, query string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(k, v)
        found = memory.cold_fallback(asked, docs, 3)
        assert "slice" in [k for k in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin [") if k.startswith("block")][0].split("]")[0]  # one block alone would be one task
        got = sorted(map(tuple, found.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(1, i + 1, i, "contains") for i in range(3)] + [(2, i + 1, i, "first") for i in range(3)]


def test_pairs_are_dealt_by_the_number_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "NODES", 50)
    rows = spark.range(600).selectExpr("id % 60 AS call", "id DIV 60 AS node")
    made = graph.paired(rows)
    assert made.rdd.getNumPartitions() == 12 and made.count() == 60 * 45
    assert {r["count"] for r in graph.edges(rows).collect()} == {60} and graph.edges(rows.limit(0)).count() == 0
