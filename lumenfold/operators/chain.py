"""From a text to a judged answer: a memory is constructed of lines, questions get contexts by their type, answers are made and judged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import fidelity, text as T
from lumenfold.operators import gate, memory, reuse
from lumenfold.operators.ordered import stage


def construct(texts: DataFrame, session: str = "session", text: str = "text", dim: int = 64, **options) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) of texts whose non-empty lines are written to their session's memory in order: cold (session, seq, id, text) has all lines, hot those
    that were admitted, as they were committed, with their vectors. ids are session and line, joined by a colon."""
    lines = texts.select(F.col(session).cast("string").alias("session_id"), F.posexplode_outer(T.lines(F.col(text))).alias("seq", "text")).where("text IS NOT NULL")
    lines = stage(lines, "lines")
    made = stage(gate.ingest(lines, dim=dim, **options), "ingested")
    name = F.concat_ws(":", "session", "seq").alias("id")
    cold = lines.withColumnRenamed("session_id", "session").select("session", "seq", name, "text")
    hot = made.where("action = 'hot'").select("session", "seq", name, F.col("committed").alias("text"), fidelity.hashed_encoding(F.col("committed"), dim).alias("vector"))
    return stage(hot, "hot"), cold


def contexts(questions: DataFrame, hot: DataFrame, cold: DataFrame, graph: DataFrame | None = None, threshold: float = reuse.THRESHOLD, most: int = reuse.CACHE, table: dict[str, tuple[int, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, qa_type, how, source_id, context) of questions (session, query_id, query, vector), in the order of query_id, and the retrievals to record.

    A question's type decides its depth and route. Its session's cache is asked first, by the question itself and then by
    similarity; one plan retrieves for all that miss. Contexts are the texts in their order, hot ones as committed.
    """
    kind = T.question_type(F.col("query"))
    depth, route = T.policy(F.col("qa_type"), table)
    typed = stage(questions.select("session", "query_id", "query", "vector", F.md5("query").alias("uuid")).withColumn("qa_type", kind).withColumn("k", depth).withColumn("route", route), "typed")
    decided = stage(reuse.context_reuse(typed, seq="query_id", threshold=threshold, most=most).withColumnRenamed("seq", "query_id").withColumnRenamed("source_seq", "source_id"), "decided")
    missed = typed.join(decided.where("how = 'miss'").select("session", "query_id"), ["session", "query_id"], "left_semi")
    found, record = memory.retrieve_batch(missed, hot, cold, graph)
    at_hand = hot.select("id", F.col("text").alias("_hot"))
    texts = found.withColumnRenamed("how", "place").join(cold.select("id", "text"), "id").join(at_hand, "id", "left")
    texts = texts.select(F.col("query_id").alias("source_id"), "rank", F.when(F.col("place") == "hot", F.coalesce("_hot", "text")).otherwise(F.col("text")).alias("text"))
    joined = texts.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
    out = decided.join(typed.select("query_id", "qa_type"), "query_id").join(joined, "source_id", "left")
    return out.select("query_id", "qa_type", "how", "source_id", F.coalesce("context", F.lit("")).alias("context")), record


def judged(questions: DataFrame, contexts: DataFrame, answer: Callable[[Column, Column], Column], judge: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, qa_type, how, answer, score) of questions (query_id, query, expected): answer(question, context), and judge(answer, expected)."""
    met = questions.select("query_id", "query", "expected").join(contexts, "query_id").withColumn("answer", answer(F.col("query"), F.col("context")))
    return met.select("query_id", "qa_type", "how", "answer", judge(F.col("answer"), F.col("expected")).alias("score"))
