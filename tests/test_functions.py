import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import fidelity as V
from lumenfold.functions import patterns as P
from lumenfold.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, kind, gap", [
    ("Migration failed: lock timeout after 30s on users table", "migration_failure", 0.0),
    ("all good", "migration_failure", 1.0),
    ("called fetch() and it returned 3 rows", "tool_call", 0.0),
    ("deployed to staging", "deployment", 0.5),
    ("TypeError at line 3", "error", 0.0),
    ("3 tests failed in tests/test_auth.py", "test_result", 0.0),
    ("src/auth.ts was modified", "file_modification", 0.0),
])
def test_schema_gap(spark, text, kind, gap):
    assert one(spark, T.schema_gap(F.col("t"), kind), t=text) == pytest.approx(gap)


def test_schema_pair_of_a_lossy_summary_is_one(spark):
    gap = T.schema_gap_pair(F.col("a"), F.col("b"), "migration_failure")
    assert one(spark, gap, a="Migration failed: lock timeout after 30s on users table", b="The migration had a problem") == 1.0
    assert one(spark, gap, a="nothing here", b="") == 0.0


@pytest.mark.parametrize("text, kind", [("", ""), ("TypeError at line 3", "error"), ("staging deploy failed", "deployment")])
def test_detect_schema(spark, text, kind):
    assert one(spark, T.detect_schema(F.col("t")), t=text) == kind


@pytest.mark.parametrize("q, kind", [
    ("What is in src/config/env.ts?", "entity"), ("Is it true that it works?", "verification"), ("How to restart it", "procedural"),
    ("Why did it break", "causal"), ("Give an overview", "summary"), ("Who is in charge", "factoid"), ("Hello there", "unknown"),
])
def test_question_type(spark, q, kind):
    assert one(spark, T.question_type(F.col("t")), t=q) == kind


@pytest.mark.parametrize("q, kind", [("what happened at step 12", "precision"), ("where is auth.py", "entity"), ("error code in auth.py", "ambiguous"), ("tell me more", "context")])
def test_query_class(spark, q, kind):
    assert one(spark, T.query_class(F.col("t")), t=q) == kind


def test_entities_and_artifacts(spark):
    assert one(spark, T.entity_texts(F.col("t")), t="At Step 4 API_KEY in src/a.py gave 503 and ValueError") == ["503", "api_key", "src/a.py", "step 4", "valueerror"]
    assert one(spark, T.artifacts(F.col("t")), t="src/a.ts and JWT_SECRET at /api/users gave 404, not 14045") == ["src/a.ts", "JWT_SECRET", "/api/users", "404"]
    assert one(spark, T.entity_hint(F.col("t")), t="see src/lib/x.py or HTTP_X") == "src/lib/x.py"
    assert one(spark, T.step_number(F.col("t")), t="at step 42") == 42


def test_tokenizers(spark):
    assert one(spark, T.lexical_tokens(F.col("t")), t="The quick_fox, a b-cd/ef") == ["the", "quick_fox", "cd", "ef"]
    assert one(spark, T.token_count(F.col("t")), t=" a b  c\n") == 3
    assert one(spark, T.sections(F.col("t")), t="intro\n- one\n2. two") == ["intro", "one", "two"]
    assert one(spark, T.dedupe_sentences(F.col("t")), t="A b. C d. a B. E") == "A b. C d. E"
    assert one(spark, T.nesting_depth(F.col("t")), t="}{[]}{{[") == 3


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, V.epe(a, a)) == 0 and one(spark, V.epe(a, b)) == 0.5
    assert one(spark, V.cosine_distance(a, b)) == 1.0
    assert one(spark, V.normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.hashed_encoding(F.lit(""))) is None
    v = one(spark, V.hashed_encoding(F.col("t")), t="alpha beta beta")
    assert len(v) == 64 and math.isclose(sum(x * x for x in v), 1)


def test_budgets(spark):
    plan = lambda **k: V.budget_plan(F.lit(k.get("z", 0.0)), F.lit(k.get("kind", "BACKGROUND")), F.lit(k.get("art", False)), F.lit(k.get("conf", 0.9)))
    assert one(spark, plan(art=True)) == 1.0
    assert one(spark, plan()) == pytest.approx(0.3)
    assert one(spark, plan(kind="FACTUAL", conf=0.0)) == pytest.approx(0.3)
    assert one(spark, plan(kind="FACTUAL", z=10.0)) == 1.0
    assert one(spark, V.write_budget(F.lit("BACKGROUND"), F.lit(0.0), F.lit(False))) == pytest.approx(0.3)


def test_confidence(spark):
    e = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, V.share(e(), e("a"))) == 1.0
    assert one(spark, V.gate_score(e("a", "b"), e("a"), e("a", "b"))) == 0.5
    assert one(spark, V.answer_confidence(e("a"), e("a"), e("a"), F.lit(2.0))[2]) == pytest.approx(1.0)
    assert [one(spark, V.gate_route(F.lit(x))) for x in (0.7, 0.4, 0.1)] == ["hot_cache", "enriched", "cold_storage"]


def test_facts_are_found_as_the_sql_finds_them_in_one_pass(spark):
    facts = {p for _, _, _, p in P.SCHEMAS}
    text = "prodé; 7 TESTS pass in /a/b.spec.ts" + " x.y" * 3000
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string").select("id", *[T.has_fact(F.col("t"), p).alias(f"f{i}") for i, p in enumerate(sorted(facts))])
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["id"]: list(r)[1:] for r in rows.collect()}
    asked = ", ".join(f"regexp_matches(?, '(?i)(?:' || '{p.replace(chr(39), chr(39) * 2)}' || ')')" for p in sorted(facts))
    assert got[1] == list(duckdb.execute(f"SELECT {asked}", [text] * len(facts)).fetchall()[0])  # a word ends before a letter that is not ASCII
    assert got[2] == [None] * len(facts) and not any(got[3])
    assert one(spark, T.has_fact(F.col("t"), r"(?<=a)b"), t="AB") is True  # what RE2 can't say
