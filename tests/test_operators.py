import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import fidelity as V
from lumenfold.functions import text as T
from lumenfold.operators import compress, gate, graph, induce, lexical, metrics, pairs, retrieve, segment, state, vectors
from lumenfold.plans import catalogue


def test_bm25_ranks_and_skips_documents_without_terms(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red fox fox"), (3, "blue"), (4, "")], "doc_id int, text string")
    found = lexical.bm25_topk(spark.createDataFrame([(0, "red fox")], "query_id int, query string"), docs, 2).collect()
    assert [r["rank"] for r in found] == [1, 2] and {r["id"] for r in found} == {1, 2}


def test_search_falls_back_to_containment(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "xyz")], "doc_id int, text string")
    assert [r["id"] for r in lexical.search(docs, "bcd").collect()] == [1]


@pytest.mark.parametrize("calls, weight", [(1, 1 / 3), (5, 5 / 7), (49, 49 / 51)])
def test_graph_weight(spark, calls, weight):
    rows = spark.createDataFrame([(i, n) for i in range(calls) for n in ("a", "b")], "call int, node string")
    edge = graph.edges(rows).first()
    assert edge["count"] == calls and edge["weight"] == pytest.approx(weight)
    assert graph.neighbors(graph.edges(rows)).count() == 2
    back = graph.edge_weight(spark.createDataFrame([("b", "a"), ("a", "z")], "a string, b string"), graph.edges(rows)).collect()
    assert sorted(r["weight"] for r in back) == pytest.approx([0.0, weight])


def test_cold_calls_count_three(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", False)], "call int, node string, cold boolean")
    assert graph.edges(rows, cold="cold").first()["count"] == 3


def test_fact_index_and_running_references(spark):
    rows = state.fact_rows(spark.createDataFrame([("s", 1, "a.py"), ("s", 2, "a.py b.py"), ("t", 1, "a.py")], "session string, seq int, text string"), "session", "seq")
    index = {(r["session"], r["entity"]): r["ref_count"] for r in state.fact_index(rows).collect()}
    assert index == {("s", "a.py"): 2, ("s", "b.py"): 1, ("t", "a.py"): 1}
    assert {(r["session"], r["seq"], r["entity"]): r["ref_count"] for r in state.running_references(rows).collect()}["s", 2, "a.py"] == 2


def test_eviction_goes_on_until_seventy_percent(spark):
    rows = spark.createDataFrame([("x", i, 10, i, 0, 0, 0.5) for i in range(1, 11)], "g string, seq int, tokens int, turn int, misses int, hits int, novelty double")
    gone = sorted(r["seq"] for r in state.evict(rows, 100, ["g"]).where("evicted").collect())
    assert gone == [8, 9, 10]
    assert sorted(r["seq"] for r in state.evict(rows, 100, ["g"], recency="age").where("evicted").collect()) == [1, 2, 3]


def test_contradictions_go_back_in_time(spark):
    rows = spark.createDataFrame([("s", 1, "the deploy succeeded", [1.0, 0.0]), ("s", 2, "the deploy failed", [0.0, 1.0]), ("t", 3, "it failed", [0.0, 1.0])], "session string, seq int, text string, vector array<double>")
    assert [(r["seq"], r["stale_seq"]) for r in state.contradictions(rows, "session", "seq").collect()] == [(2, 1)]


def test_artifact_index_keeps_the_last_mention(spark):
    rows = spark.createDataFrame([(1, "src/A.ts"), (2, "src/a.ts is 404")], "turn int, text string")
    assert {(r["key"], r["path"], r["type"], r["turn"]) for r in state.artifact_index(rows).collect()} == {("src/a.ts", "src/a.ts", "file", 2), ("404", "404", "error", 2)}


def test_extractive_keeps_order(spark):
    docs = spark.createDataFrame([(1, "Plain words here. The critical error must be fixed. Plain words here."), (2, "one two three four")], "doc_id int, text string")
    got = {r["id"]: r["compressed"] for r in compress.extractive(docs, 0.4).collect()}
    assert "critical error" in got[1] and got[2] == "one two"


def test_ladder_takes_the_first_faithful_attempt(spark):
    same = lambda a, b: 1 - F.char_length(b) / F.char_length(a)
    got = spark.createDataFrame([("x" * 10,)], "t string").select(compress.ladder(F.col("t"), F.lit(0.2), T.truncate, same, lambda a, b: F.lit(0.0)).alias("y")).first()["y"]
    assert len(got) == 6


def test_report_and_backends(spark):
    row = compress.report(spark.createDataFrame([(1.0,), (0.3,)], "budget double")).first()
    assert (row["segments"], row["high"], row["low"]) == (2, 1, 1)
    with pytest.raises(ValueError):
        compress.backend("nothing")


def test_gate_by_tokens_and_vectors(spark):
    rows = spark.createDataFrame([("s", 0, "Alpha 1", [1.0, 0.0]), ("s", 1, "Alpha 1", [1.0, 0.0]), ("s", 2, "Beta", [1.0, 0.0]), ("s", 3, "plain", [0.0, 1.0])], "session_id string, seq int, text string, vector array<double>")
    assert [r["novel"] for r in gate.novelty_gate(rows).orderBy("seq").collect()] == [True, False, True, True]


def test_admit_forgets_after_fifty():
    axis = lambda k: np.eye(60)[k]
    out = list(gate.admit([axis(k) for k in range(51)] + [axis(0)], [False] * 52, 0.5, deque(maxlen=50)))
    assert out[-1][0]


def test_ingest_replay(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(["Deploy 12 failed", "Deploy 12 failed", "Users table lock timeout after 30s"])], "session_id string, seq int, text string")
    got = gate.ingest(rows).orderBy("seq").collect()
    assert [r["action"] for r in got] == ["hot", "cold_only", "hot"] and got[2]["schema"] == "migration_failure"
    assert gate.dump(gate.ingest(rows)).first()["memory"].startswith("[0] ")


def test_retrieval_order_and_fusion(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "query_id int, rank int, id string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "z")], "query_id int, rank int, id string")
    assert [r["id"] for r in retrieve.ordered_union([a, b], 3).orderBy("rank").collect()] == ["x", "y", "z"]
    assert retrieve.reciprocal_rank_fusion([a, b], 1).first()["id"] == "y"


def test_escalation_stops_at_confidence(spark):
    qs = spark.createDataFrame([(1,), (2,)], "question_id int")
    stage = lambda route, c: spark.createDataFrame([(1, route, c[0]), (2, route, c[1])], "question_id int, route string, confidence double")
    got = {r["question_id"]: (r["attempt"], r["route"]) for r in retrieve.escalate(qs, [stage("hot_cache", (0.8, 0.1)), stage("enriched", (0.9, 0.2)), stage("cold_storage", (0.9, 0.3))]).collect()}
    assert got == {1: (1, "hot_cache"), 2: (3, "cold_storage")}


def test_segmenter(spark):
    text = "## Head\n\nfirst part of the text with words\n\n- a b\n- c d\n\nshort\n\nlast paragraph with five words"
    long = " ".join(f"word{i} " * 99 + "end." for i in range(5))
    rows = segment.segments(spark.createDataFrame([(1, text), (2, long), (3, "")], "session_id int, text string")).orderBy("id", "pos").collect()
    assert [r["segment"] for r in rows if r["id"] == 1] == ["## Head first part of the text with words", "- a b - c d", "short last paragraph with five words"]
    assert [len(r["segment"].split()) for r in rows if r["id"] == 2] == [300, 200]


def test_metrics(spark):
    rows = spark.createDataFrame([("d", 1.0, 0.5, 10, 5, None), ("d", 0.0, 0.5, 10, 5, None), ("d", None, None, None, None, "boom")], "domain string, score double, compression_ratio double, original_tokens int, compressed_tokens int, error string")
    r = metrics.episode_metrics(rows, ["domain"]).first()
    assert (r["episodes"], r["errors"], r["mean_score"], r["std_score"]) == (2, 1, 0.5, 0.5)


def test_pairs(spark):
    df = spark.createDataFrame([("it broke because disk full", "all fine after the reboot")], "a string, b string")
    got = df.select(pairs.causal_inversion(F.col("a"), F.lit(0)).alias("i"), pairs.context_swap(F.col("a"), F.col("b")).alias("s"), pairs.causal_inversion(F.lit("nothing"), F.lit(0)).alias("n")).first()
    assert got["i"] == "it broke because successful completion" and got["s"] == "it broke after the reboot" and got["n"] is None


def test_families_of_a_long_chain(spark):
    # each set shares nine of eleven fields with the next one only
    rows = [(i, ", ".join(f"f{k}=1" for k in range(i, i + 10))) for i in range(60)]
    artifacts = spark.createDataFrame(rows, "artifact_id int, artifact string")
    assert {r["id"]: r["family"] for r in induce.families(artifacts, most=0.2).collect()} == {i: 0 for i in range(60)}
    with pytest.raises(RuntimeError):
        induce.families(artifacts, most=0.2, rounds=2)


def test_close_sets_as_brute_force(spark):
    rng = random.Random(2)
    sets = {frozenset(["all", *rng.sample("abcdefghijkl", rng.randint(0, 9))]) for _ in range(120)}
    rows = [(i, ", ".join(f"{k}=1" for k in x)) for i, x in enumerate(sets)]
    wanted = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 1 - len(x & y) / len(x | y) <= 0.30}
    found = induce.close_sets(induce.field_sets(spark.createDataFrame(rows, "artifact_id int, artifact string")))
    assert {(r["a"], r["b"]) for r in found.collect()} == wanted


def test_schema_induction_reads_the_pages(spark, tmp_path):
    pages = [(i, f"http://h.org/?page={i}&ref=x", '<p id="a">') for i in range(6)] + [(6, None, None), (7, "http://h.org/?q=1", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {(r["page_id"], r["family"], r["members"]) for r in catalogue.QUERIES["page_families"](spark, str(tmp_path)).collect()} == {(i, 0, 6) for i in range(6)}
    assert {r["field"] for r in catalogue.QUERIES["page_induced_fields"](spark, str(tmp_path)).collect()} == {"page", "ref", "id"}


def test_families(spark):
    rows = spark.createDataFrame([(i, '{"id": %d, "name": "x"}' % i) for i in range(5)] + [(9, "plain")], "artifact_id int, artifact string")
    assert {r["id"]: r["family"] for r in induce.families(rows).collect()} == {i: 0 for i in range(5)}
    assert {(r["field"], r["required"]) for r in induce.induced_fields(induce.families(rows)).collect()} == {("id", True), ("name", True)}


def test_topk_skips_itself(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id int, embedding array<double>")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert {r["query_id"]: r["id"] for r in vectors.cosine_topk(asked, rows, 1).collect()} == {1: 2, 2: 1, 3: 2}


def test_z_score_of_a_constant_is_zero(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([("s", 2.0), ("s", 2.0)], "s string, x double")
    assert {r["z"] for r in rows.select(V.z_score(F.col("x"), Window.partitionBy("s")).alias("z")).collect()} == {0.0}


def test_anchors_and_roles(spark):
    from lumenfold.operators.anchors import anchors, token_roles

    rows = [("s", i, "alpha beta gamma delta") for i in range(25)] + [("s", 25, "rareword at 42 in src/a.py alpha")] + [("t", 0, "rareword 7")]
    got = {(r["session"], r["seq"]): r["anchors"] for r in anchors(spark.createDataFrame(rows, "session_id string, seq int, text string")).collect()}
    assert got["s", 25][:3] == ["42", "src/a.py", "rareword"] and got["t", 0] == ["7"]
    roles = spark.createDataFrame([("The Alpha thing",)], "t string").select(token_roles(F.col("t"), F.array(F.lit("alpha"))).alias("r")).first()["r"]
    assert [x["role"] for x in roles] == ["stopword", "anchor", "compressible"]


def test_rewrite_and_trust(spark):
    counters = spark.createDataFrame([("k", 3, 0), ("m", 2, 0)], "key string, misses int, last_rewrite int")
    entries = spark.createDataFrame([("k", 0.3, "ab"), ("m", 0.3, "ab")], "key string, budget double, text string")
    originals = spark.createDataFrame([("k", "abcdefghij"), ("m", "x")], "key string, original string")
    missed = spark.createDataFrame([("k", "where is Foo"), ("k", "is foo in")], "key string, query string")
    r = state.rewrite(entries, counters, missed, originals, T.truncate, 6).collect()
    assert [(x["key"], x["new_budget"], x["anchors"], x["text"]) for x in r] == [("k", 0.5, ["foo", "where"], "abcde")]
    used = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "question_id int, id string")
    trust = {r["question"]: r["trust"] for r in retrieve.hot_trust(used, spark.createDataFrame([("a", 0.2), ("b", 0.4)], "id string, r_build double")).collect()}
    assert trust == pytest.approx({1: 0.7, 2: 1.0})


def test_keyword_lines_and_faithful_pairs(spark):
    rows = spark.createDataFrame([(0, "nothing"), (1, "the port opened at step 3"), (2, "port closed")], "pos int, line string")
    assert [r["score"] for r in retrieve.keyword_lines(rows, "which port at step 3").collect()] == [5, 1]
    short = lambda t, r: spark.createDataFrame([(t,)], "t string").select(pairs.faithful_compress(F.col("t"), r).alias("c")).first()["c"]
    assert short("We did the long thing in order to win", 0.9) == "We long thing to win"
    assert short("one two three four in five six seven", 0.5) == "one two three four" and short("one two three in five six seven eight", 0.5) == "one two three six"


def test_entities_where_little_is_searched(spark):
    from lumenfold.functions import text as T

    rows = spark.createDataFrame([("a.b and x.py.",), ("é.çà HTTP 404",), ("A_Error 404 NOT",), ("4040 Ok",), ("sTEP\t3 [Step 4]",), ("step.",), ("",), (None,)], "text string")
    got = [None if r["e"] is None else [tuple(x) for x in r["e"]] for r in rows.select(T.typed_entities(F.col("text")).alias("e")).collect()]
    assert got == [[("x.py", "file_path")], [("é.çà", "file_path"), ("HTTP 404", "error_code")], [("A_Error", "error_code"), ("404 NOT", "error_code")], [("040 O", "error_code")], [("sTEP\t3", "step_reference"), ("[Step 4]", "step_reference")], [], [], None]


def test_entities_bear_their_types(spark):
    from lumenfold.operators import memory

    rows = spark.createDataFrame([("s", 0, "see src/a.py at step 3"), ("s", 1, "src/a.py again"), ("s", 2, "src/a.py and more"), ("s", 3, "plain")], "session string, seq long, text string")
    facts = {(r["seq"], r["entity"], r["type"]) for r in state.fact_rows(rows, "session", "seq").collect()}
    assert {(0, "src/a.py", "file_path"), (0, "step 3", "step_reference")} <= facts
    made = {r["seq"]: (r["most"], r["budget"]) for r in memory.write_budgets(rows.withColumn("text", F.regexp_replace("text", "src/", "x/")), "session", "seq").collect()}
    assert made[2] == (3, 1.0) and made[1][0] == 2 and made[1][1] < 1 and made[3][0] == 0


def test_retry_asks_only_the_unsure_again(spark):
    from lumenfold.operators import memory

    asked = []

    def find(queries, route, k):
        asked.append((route, k, sorted(r["query_id"] for r in queries.collect())))
        return queries.select("query_id", F.lit(k).alias("rank"), F.lit(0).alias("id"))

    sure = lambda found: found.select("query_id", F.when((F.col("query_id") == 1) | (F.col("rank") > 3) & (F.col("query_id") == 2), 0.9).otherwise(0.1).alias("confidence"))
    got = {tuple(r) for r in memory.retry(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), find, sure, 3, "hot_cache").collect()}
    assert got == {(1, 1, "hot_cache", 3, 0.9), (2, 2, "enriched", 6, 0.9), (3, 3, "cold_storage", 8, 0.1)}
    assert asked == [("hot_cache", 3, [1, 2, 3]), ("enriched", 6, [2, 3]), ("cold_storage", 8, [3])]


def test_new_session_keeps_cold_rows_facts_and_graph(spark):
    from lumenfold.operators import memory

    one = spark.createDataFrame([("a", 1), ("b", 2)], "session string, seq long")
    left = memory.new_session({"cold": one, "facts": one, "hot": one}, "a")
    assert left["cold"].count() == 2 and [r["session"] for r in left["hot"].collect()] == ["b"]


def test_sentences_are_scored_in_their_own_row(spark):
    docs = spark.createDataFrame([(1, "red fox. red lake! critical red"), (2, None), (3, "one"), (3, "one two")], "doc_id int, text string")
    made = compress.sentence_scores(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # no token is a row
    got = {(r["id"], r["pos"]): (r["sentences"], r["score"]) for r in made.collect()}
    rare, common = math.log(4 / 2) + 1, math.log(4 / 4) + 1
    assert got[1, 0] == (3, pytest.approx((rare + common) / 2)) and got[1, 2] == (3, pytest.approx((rare + common) / 2 + 0.3))
    assert set(got) == {(1, 0), (1, 1), (1, 2), (3, 0)}
    assert got[3, 0][1] == pytest.approx(math.log(2 / 3) + 1 + (math.log(2 / 3) + 1) / 2 + (math.log(2 / 2) + 1) / 2)
