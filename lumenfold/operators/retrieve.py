"""Routed retrieval: vector, lexical and graph candidates fused in order, and escalation while confidence is low."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import graph as G
from lumenfold.operators.lexical import bm25_topk
from lumenfold.operators.vectors import cosine_topk

#: A route's successor, when an answer's confidence is too low.
NEXT_ROUTE = {"hot_cache": "enriched", "enriched": "cold_storage", "cold_storage": "cold_storage"}


def ordered_union(parts: list[DataFrame], k: int) -> DataFrame:
    """(query_id, rank, id): parts (query_id, rank, id) one after another, each id once at its first place, k at most."""
    both = None
    for i, p in enumerate(parts):
        p = p.select("query_id", "id", F.lit(i).alias("part"), "rank")
        both = p if both is None else both.unionByName(p)
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("part", "rank")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id")


def reciprocal_rank_fusion(parts: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """An alternative to the ordered union: the sum of 1 / (c + rank)."""
    both = None
    for p in parts:
        p = p.select("query_id", "id", "rank")
        both = p if both is None else both.unionByName(p)
    score = both.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(c) + F.col("rank"))).alias("score"))
    ranked = score.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id")


def enriched(queries: DataFrame, entries: DataFrame, graph: DataFrame | None, k: int, id_col: str = "id", text_col: str = "text", vector_col: str = "vector", seeds: int = 5, fuse=ordered_union) -> DataFrame:
    """(query_id, rank, id): 2k by vector, 2k by words, then the graph's neighbours of the first seeds, cut to k.

    queries has query_id, query and vector.
    """
    near = cosine_topk(queries, entries, 2 * k, query_vector="vector", id_col=id_col, vector_col=vector_col, skip_self=False)
    words = bm25_topk(queries, entries, 2 * k, id_col=id_col, text_col=text_col)
    found = [near, words]
    if graph is not None:
        base = ordered_union(found, seeds)
        walked = base.join(G.neighbors(graph, base, 3, 0.2, "id").withColumnRenamed("rank", "step"), F.col("id") == F.col("node"))
        found.append(walked.select("query_id", (F.col("rank") * 10 + F.col("step")).alias("rank"), F.col("neighbor").alias("id")))
    return fuse(found, k)


def escalate(questions: DataFrame, stages: list[DataFrame], threshold: float = 0.70) -> DataFrame:
    """The first confident attempt of each question, else its last: stages (question_id, route, confidence), in order."""
    both = None
    for i, s in enumerate(stages):
        s = s.select("question_id", F.lit(i + 1).alias("attempt"), "route", "confidence")
        both = s if both is None else both.unionByName(s)
    sure = F.col("confidence") >= threshold
    best = both.groupBy("question_id").agg(F.min_by(F.struct("attempt", "route", "confidence"), F.when(sure, F.col("attempt"))).alias("good"), F.max_by(F.struct("attempt", "route", "confidence"), "attempt").alias("last"))
    return questions.join(best, "question_id").select("question_id", F.coalesce("good", "last").alias("x")).select("question_id", "x.*")


def hot_trust(used: DataFrame, scores: DataFrame, question: str = "question_id", entry: str = "id") -> DataFrame:
    """(question, trust): one less the mean R_build of the entries an answer used; 1 if it used none that is known."""
    joined = used.select(F.col(question).alias("question"), F.col(entry).alias("id")).distinct().join(scores.select("id", "r_build"), "id", "left")
    return joined.groupBy("question").agg((1 - F.coalesce(F.avg("r_build"), F.lit(0.0))).alias("trust"))


def keyword_lines(text: DataFrame, query: str, k: int = 10, line_col: str = "line", pos_col: str = "pos") -> DataFrame:
    """(pos, line, score): the k lines with the most query words (three letters or more), and 3 for each step number of the query."""
    import re

    score = F.lit(0)
    for w in sorted({x for x in re.findall(r"[a-z0-9_]+", query.lower()) if len(x) >= 3}):
        score = score + F.lower(F.col(line_col)).contains(w).cast("int")
    for n in sorted(set(re.findall(r"(?i)step\s+([0-9]+)", query))):
        score = score + F.when(F.col(line_col).rlike(rf"(?i)\bstep\s+{n}\b"), 3).otherwise(0)
    return text.select(F.col(pos_col).alias("pos"), F.col(line_col).alias("line"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "pos").limit(k)
