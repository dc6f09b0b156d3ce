"""A session memory's stores and look-ups as set operations: cold rows, facts, hot entries, fallbacks and retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import fidelity, text as T
from lumenfold.operators import graph as G
from lumenfold.operators import state
from lumenfold.operators.lexical import bm25_topk
from lumenfold.operators.ordered import stage
from lumenfold.operators.retrieve import NEXT_ROUTE, ordered_union
from lumenfold.operators.vectors import BLOCK, cosine_topk


# stores -------------------------------------------------------------------


def look_up(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a store (cold rows, facts) that are asked for by key: one equi-join for all questions; repeated questions count once."""
    return rows.join(wanted.select(*on).distinct(), on)


def store(entries: DataFrame, text: str = "text") -> DataFrame:
    """Entries as the hot store holds them: their tokens, no mark, no miss or hit yet."""
    return entries.withColumns({"tokens": T.token_count(F.col(text)), "stale": F.lit(False), "misses": F.lit(0), "hits": F.lit(0)})


def mark_stale(entries: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Entries whose keys are in `gone` marked as stale; marks that were there stay."""
    marks = gone.select(*on).distinct().withColumn("_stale", F.lit(True))
    return entries.join(marks, on, "left").withColumn("stale", F.col("stale") | F.coalesce("_stale", F.lit(False))).drop("_stale")


def evict_stale(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("stale"))


def active_vectors(entries: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Keys and vectors of what is not stale."""
    return entries.where(~F.col("stale") & F.col(vector).isNotNull()).select(*keys, vector)


def new_session(tables: dict[str, DataFrame], session: str, keeps: tuple[str, ...] = ("cold", "facts", "graph")) -> dict[str, DataFrame]:
    """What a new session begins with: cold rows, facts and graph as they are, all else without rows of the session."""
    return {name: t if name in keeps else t.where(F.col("session") != session) for name, t in tables.items()}


def stats(hot: DataFrame, cold: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the sizes of all stores."""
    live = evict_stale(hot).agg(F.count("*").alias("hot_entries"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("hot_tokens"))
    counts = [t.agg(F.count("*").alias(name)) for t, name in ((cold, "cold_rows"), (facts, "facts"), (edges, "edges"))]
    for c in counts:
        live = live.crossJoin(c)  # one row each
    return live


def references(segments: DataFrame, session: str, seq: str, text: str = "text", extractor=T.typed_entities) -> DataFrame:
    """(session, seq, most): for each segment with an entity, how often the most referenced of them was written by then.

    Segments of an entity are numbered by their order; a segment counts itself.
    """
    rows = state.fact_rows(segments, session, seq, text, extractor)
    return state.running_references(rows).groupBy("session", "seq").agg(F.max("ref_count").alias("most"))


def write_budgets(segments: DataFrame, session: str, seq: str, text: str = "text", kind: Column | None = None, least: int = 3) -> DataFrame:
    """(session, seq, schema, gap, most, budget): the write path's budget; all of a segment is kept that holds an artifact or an entity referenced `least` times."""
    body = F.col(text)
    kinds = T.P.SCHEMA_TYPES
    rows = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), T.detect_schema(body).alias("schema"), F.struct(*[T.schema_gap(body, k).alias(k) for k in kinds]).alias("gaps"), T.is_artifact(body).alias("artifact"), (kind if kind is not None else F.lit("BACKGROUND")).alias("kind"))
    gap = F.coalesce(*[F.when(F.col("schema") == k, F.col(f"gaps.{k}")) for k in kinds], F.lit(0.0))
    known = rows.join(references(segments, session, seq, text), ["session", "seq"], "left").withColumn("gap", gap).withColumn("most", F.coalesce("most", F.lit(0)))
    return known.select("session", "seq", "schema", "gap", "most", fidelity.write_budget(F.col("kind"), F.col("gap"), F.col("artifact") | (F.col("most") >= least)).alias("budget"))


def session_plans(segments: DataFrame, session: str, seq: str, score: Column) -> DataFrame:
    """(session, seq, z, budget): plans of whole sessions, of type BACKGROUND without confidence. Means and deviations are worked out by session and joined back."""
    rows = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), score.cast("double").alias("score"))
    of = rows.groupBy("session").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))
    z = rows.join(of, "session").select("session", "seq", ((F.col("score") - F.col("mean")) / F.greatest("spread", F.lit(1e-9))).alias("z"))
    return z.withColumn("budget", fidelity.budget_plan(F.col("z"), F.lit("BACKGROUND"), F.lit(False), F.lit(0.0)))


# retrieval ----------------------------------------------------------------


def cold_fallback(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, how) of queries (query_id, query): ranked; where that finds nothing, rows that contain one of the query's words; else the first rows.

    Containment is asked of the queries without a ranked result only: their words are dealt into
    blocks, and every row meets every block once, by an equi-join on the block and a slice of the rows. Blocks
    are written first, so that where they are small, texts stay where they are; else a task reads a slice.
    """
    ranked = bm25_topk(queries, docs, k, id_col=id_col, text_col=text_col).select("query_id", "rank", "id", F.lit("ranked").alias("how"))
    missed = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    words = missed.select("query_id", F.explode_outer(F.array_distinct(T.whitespace_tokens(F.lower("query")))).alias("word")).where("word IS NOT NULL")
    blocks = max(1, -(-words.count() // BLOCK))
    packed = stage(words.groupBy(F.pmod(F.xxhash64("query_id", "word"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "word")).alias("words")), "words")
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = packed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"), F.pmod(F.xxhash64(id_col), F.lit(slices)).alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = low.join(packed, ["block", "slice"]).select("id", F.explode_outer(F.filter("words", lambda x: F.col("low").contains(x["word"]))).alias("x")).where("x IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy("id")
    held = met.select("x.query_id", "id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.lit("contains").alias("how"))
    rest = missed.join(held.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    first = docs.select(F.col(id_col).alias("id")).orderBy("id").limit(k).select("id", F.row_number().over(Window.orderBy("id")).alias("rank"))  # k rows
    return ranked.unionByName(held).unionByName(rest.crossJoin(F.broadcast(first)).select("query_id", "rank", "id", F.lit("first").alias("how")))


def walk(found: DataFrame, graph: DataFrame, k: int, seeds: int = 5, steps: int = 3, least: float = 0.2) -> DataFrame:
    """found (query_id, rank, id) and behind it the graph's neighbours of the first seeds, cut to k."""
    base = found.where(F.col("rank") <= seeds)
    near = G.neighbors(graph, base, steps, least, "id").withColumnRenamed("rank", "step")
    walked = base.join(near, F.col("id") == F.col("node")).select("query_id", (F.col("rank") * 10 + F.col("step")).alias("rank"), F.col("neighbor").alias("id"))
    return ordered_union([found, walked], k)


def routed(queries: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], route: str = "route") -> DataFrame:
    """(query_id, route, rank, id): each query by the function of its own route; a route sees its queries only. An unknown route is an error."""
    known = queries.withColumn(route, F.when(F.col(route).isin(*routes), F.col(route)).otherwise(F.raise_error(F.concat(F.lit("unknown route "), F.coalesce(route, F.lit("null"))))))
    out = None
    for name, find in routes.items():
        part = find(known.where(F.col(route) == name)).select("query_id", F.lit(name).alias("route"), "rank", "id")
        out = part if out is None else out.unionByName(part)
    return out


def retrieve_batch(questions: DataFrame, hot: DataFrame, cold: DataFrame, graph: DataFrame | None, k: int = 5, wide: int | None = None, seeds: int = 5) -> tuple[DataFrame, DataFrame]:
    """What a batch of questions (query_id, query, vector, route) finds, (query_id, route, rank, id, how), and the retrievals to record, (call, node, cold).

    `hot_cache` takes the nearest entries (id, text, vector); `enriched` those, then by words, `wide` (2k) of each, then the graph's
    neighbours of the first seeds, and texts that are not among the nearest come from cold rows (id, text); `cold_storage` searches cold
    rows. What finds nothing falls to cold storage. how is hot or cold, and ranked, contains or first of a cold search. Enriched questions
    record their first k seeds together, as cold calls if any text came from cold rows: `graph.replay` makes the next batch's graph of it.
    Questions may have a depth of their own, in a column k.
    """
    own = F.col("k") if "k" in questions.columns else F.lit(k)
    asked = questions.select("query_id", "query", "vector", "route", own.cast("int").alias("k"))
    depths = asked.select("query_id", "route", "k", (F.lit(wide) if wide else 2 * F.col("k")).alias("wide"))
    most = (asked.agg(F.max("k")).first()[0] or 1) if "k" in questions.columns else k
    by = lambda *names: asked.where(F.col("route").isin(*names))
    deep = lambda rows, col: rows.join(depths, "query_id").where(F.col("rank") <= F.col(col))
    near = stage(deep(cosine_topk(by("hot_cache", "enriched"), hot, wide or 2 * most, query_vector="vector", id_col="id", vector_col="vector", skip_self=False), "wide"), "near")
    words = deep(bm25_topk(by("enriched"), hot, wide or 2 * most, id_col="id"), "wide")
    first = stage(ordered_union([near.where("route = 'enriched'"), words], 2 * (wide or 2 * most)), "seeds")
    parts = [first]
    if graph is not None:
        base = first.where(F.col("rank") <= seeds)
        steps = G.neighbors(graph, base, 3, 0.2, "id").withColumnRenamed("rank", "step")
        parts.append(base.join(steps, F.col("id") == F.col("node")).select("query_id", (F.col("rank") * 10 + F.col("step")).alias("rank"), F.col("neighbor").alias("id")))
    at_hand = near.select("query_id", "id", F.lit("hot").alias("how"))
    taken = deep(ordered_union(parts, most), "k").select("query_id", "rank", "id").join(at_hand, ["query_id", "id"], "left")
    known = taken.join(cold.select("id").distinct().withColumn("_cold", F.lit("cold")), "id", "left").withColumn("how", F.coalesce("how", "_cold")).where("how IS NOT NULL")
    mixed = stage(known.select("query_id", F.lit("enriched").alias("route"), "rank", "id", "how"), "mixed")
    found = near.where((F.col("route") == "hot_cache") & (F.col("rank") <= F.col("k"))).select("query_id", "route", "rank", "id", F.lit("hot").alias("how")).unionByName(mixed)
    rest = stage(by("cold_storage").unionByName(by("hot_cache", "enriched").join(found.select("query_id").distinct(), "query_id", "left_anti")).select("query_id", "query"), "rest")
    fallen = deep(cold_fallback(rest, cold, most, "id"), "k").select("query_id", "route", "rank", "id", "how")
    fetched = mixed.groupBy("query_id").agg(F.max(F.col("how") == "cold").alias("cold"))
    record = deep(first, "k").join(fetched, "query_id", "left").select(F.col("query_id").alias("call"), F.col("id").alias("node"), F.coalesce("cold", F.lit(False)).alias("cold"))
    return found.unionByName(fallen), record


def finder(hot: DataFrame, cold: DataFrame, graph: DataFrame | None) -> Callable[[DataFrame, str, int], DataFrame]:
    """What `retry` asks for: find(queries, route, k), where each route really is another search."""

    def find(queries: DataFrame, route: str, k: int) -> DataFrame:
        asked = queries.select("query_id", "query", "vector", F.lit(route).alias("route"))
        return retrieve_batch(asked, hot, cold, graph, k)[0].select("query_id", "rank", "id")

    return find


def retry(queries: DataFrame, find: Callable[[DataFrame, str, int], DataFrame], confidence: Callable[[DataFrame], DataFrame], k: int, route: str, threshold: float = 0.7, attempts: int = 3, most_k: int = 8) -> DataFrame:
    """(query_id, attempt, route, k, confidence): retrieve, and again with the next route and twice the depth while confidence is low.

    find(queries, route, k) gives (query_id, rank, id); confidence(found) gives (query_id, confidence). Only
    queries that are not confident yet are asked again; the last attempt counts where none is.
    """
    left, out = queries, None
    for attempt in range(1, attempts + 1):
        told = confidence(find(left, route, k)).select("query_id", "confidence")
        made = left.select("query_id").join(told, "query_id", "left").select("query_id", F.lit(attempt).alias("attempt"), F.lit(route).alias("route"), F.lit(k).alias("k"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
        done = made if attempt == attempts else made.where(F.col("confidence") >= threshold)
        out = done if out is None else out.unionByName(done)
        if attempt < attempts:
            left = left.join(made.where(F.col("confidence") < threshold).select("query_id"), "query_id", "left_semi")
        route, k = NEXT_ROUTE[route], min(2 * k, most_k)
    return out


def precise(hints: DataFrame, facts: DataFrame, cold: DataFrame) -> DataFrame:
    """(query_id, session, seq, text): cold rows whose segment first wrote an entity that a query names; hints has query_id and entity."""
    return hints.join(facts.select("entity", "session", "seq"), "entity").join(cold.select("session", "seq", "text"), ["session", "seq"]).select("query_id", "session", "seq", "text").distinct()


def merged(precise_rows: DataFrame, context_rows: DataFrame, most: int = 1500) -> DataFrame:
    """(query_id, seq, label, text): precise results before context, each seq once, while a query's words stay within `most`."""
    both = precise_rows.select("query_id", "seq", "text", F.lit(0).alias("part")).unionByName(context_rows.select("query_id", "seq", "text", F.lit(1).alias("part")))
    once = both.groupBy("query_id", "seq").agg(F.min_by(F.struct("part", "text"), "part").alias("x")).select("query_id", "seq", "x.*")
    order = Window.partitionBy("query_id").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = once.withColumn("words", F.sum(T.token_count(F.col("text"))).over(order)).where(F.col("words") <= most)
    return held.select("query_id", "seq", F.when(F.col("part") == 0, "PRECISE").otherwise("CONTEXT").alias("label"), "text")


def matrix_novelty(queries: DataFrame, matrix: DataFrame, query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """(query_id, novelty): one less the best cosine with a row of the matrix (id, vector); 1 if it has no other row."""
    best = cosine_topk(queries, matrix, 1, query_id, query_vector, "id", "vector").select("query_id", "score")
    return queries.select(F.col(query_id).alias("query_id")).join(best, "query_id", "left").select("query_id", F.coalesce(1 - F.col("score"), F.lit(1.0)).alias("novelty"))


# summaries ----------------------------------------------------------------


def run_summary(answers: DataFrame, kind: str, correct: Column, reduction: Column) -> DataFrame:
    """(kind, questions, accuracy, mean_reduction): of all answers (kind null) and by kind of question."""
    rows = answers.select(F.col(kind).alias("kind"), correct.cast("int").alias("ok"), reduction.alias("less"))
    cells = rows.groupBy("kind").agg(F.count("*").alias("questions"), F.sum("ok").alias("ok"), F.sum("less").alias("less"))
    total = cells.agg(F.lit(None).cast("string").alias("kind"), *[F.sum(c).alias(c) for c in ("questions", "ok", "less")])
    return cells.unionByName(total).select("kind", "questions", (F.col("ok") / F.col("questions")).alias("accuracy"), (F.col("less") / F.col("questions")).alias("mean_reduction"))
