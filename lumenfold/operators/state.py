"""Facts, references, artifacts, cache eviction, misses and rewrites, as set operations over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import fidelity
from lumenfold.functions.text import artifact_type, artifacts, typed_entities
from lumenfold.operators.ordered import join_same, running_totals


def fact_rows(segments: DataFrame, session: str, seq: str, text: str = "text", extractor=typed_entities) -> DataFrame:
    """(session, seq, entity, type): one row for each distinct entity and type of a segment."""
    found = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.explode_outer(extractor(F.col(text))).alias("e")).where("e IS NOT NULL")
    return found.select("session", "seq", F.col("e.text").alias("entity"), F.col("e.type").alias("type"))


def fact_index(rows: DataFrame) -> DataFrame:
    """One row for each session and entity: the first segment and type, and how often it was written."""
    return rows.groupBy("session", "entity").agg(F.min_by(F.struct("seq", "type"), F.struct("seq", "type")).alias("f"), F.count("*").alias("ref_count")).select("session", "entity", F.col("f.seq").alias("seq"), F.col("f.type").alias("type"), "ref_count")


def high_reference(index: DataFrame, least: int = 3) -> DataFrame:
    return index.where(F.col("ref_count") >= least)


def running_references(rows: DataFrame) -> DataFrame:
    """Each fact row with the references to its entity so far, its own segment's included."""
    so_far = Window.partitionBy("session", "entity").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("ref_count", F.count("*").over(so_far))


def artifact_index(segments: DataFrame, turn: str = "turn", text: str = "text") -> DataFrame:
    """The last mention of each artifact (case aside): key, path, type and turn."""
    rows = segments.select(F.col(turn).alias("turn"), F.posexplode(artifacts(F.col(text))).alias("pos", "path"))
    return rows.groupBy(F.lower("path").alias("key")).agg(F.max_by(F.struct("path", "turn"), F.struct("turn", "pos")).alias("x")).select("key", "x.path", artifact_type(F.col("x.path")).alias("type"), "x.turn")


def merge_artifacts(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both indexes in one; of a key the later turn, of equals the other's."""
    both = one.withColumn("_n", F.lit(0)).unionByName(other.withColumn("_n", F.lit(1)))
    return both.groupBy("key").agg(F.max_by(F.struct("path", "type", "turn"), F.struct("turn", "_n")).alias("x")).select("key", "x.*")


def hot_stats(entries: DataFrame, by: list[str], tokens: str = "tokens", stale: str = "stale") -> DataFrame:
    live = entries.where(~F.col(stale))
    return live.groupBy(*by).agg(F.count("*").alias("entries"), F.sum(tokens).cast("long").alias("tokens"))


def evict(entries: DataFrame, ceiling: int, by: list[str], seq: str = "seq", tokens: str = "tokens", keep: float = 0.7, recency: str = "as_coded") -> DataFrame:
    """Entries (seq, tokens, turn, misses, hits, novelty) with their score and whether they go.

    Entries go by score until the rest is within keep * ceiling: one goes if what is left
    after all before it is still over that. Maxima are worked out by group and joined back, what comes before
    an entry is a running total over ranges, so no group needs a task of its own.
    """
    tops = entries.groupBy(*by).agg(*[F.max(c).alias(f"_{c}") for c in ("turn", "misses", "hits")])
    scored = join_same(entries, tops, by).withColumn("score", fidelity.eviction_rank(*[(F.col(c), F.col(f"_{c}")) for c in ("turn", "misses", "hits")], F.col("novelty"), recency)).drop("_turn", "_misses", "_hits")
    summed = running_totals(scored, by, [F.desc("score"), F.col(seq)], tokens)
    return summed.withColumn("evicted", F.col("total") - F.col("before") > keep * ceiling).drop("before", "total")


def contradictions(segments: DataFrame, session: str, seq: str, text: str = "text", vector: str = "vector", least: float = 0.28, most: float | None = None) -> DataFrame:
    """(session, seq, stale_seq, distance): earlier segments of a session that a later one contradicts.

    Polarity words are matched first: only segments that hold one meet, by session and pair of words.
    """
    from lumenfold.functions.patterns import POLARITY

    low = F.lower(F.col(text))
    held = F.array(*[F.when(low.contains(w), F.lit(i * 2 + side)) for i, pair in enumerate(POLARITY) for side, w in enumerate(pair)])
    marked = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(text).alias("t"), F.col(vector).alias("v"), F.array_compact(held).alias("held"))
    long = marked.select("session", "seq", "v", F.explode("held").alias("code")).select("session", "seq", "v", F.floor(F.col("code") / 2).alias("pair"), (F.col("code") % 2).alias("side"))
    old = long.select("session", "pair", F.col("seq").alias("stale_seq"), F.col("v").alias("old_v"), F.col("side").alias("old_side"))
    met = long.join(old, ["session", "pair"]).where((F.col("side") != F.col("old_side")) & (F.col("stale_seq") < F.col("seq")))
    far = met.select("session", "seq", "stale_seq", fidelity.cosine_distance(F.col("v"), F.col("old_v")).alias("distance")).where(F.col("distance") > least)
    return (far.where(F.col("distance") <= most) if most is not None else far).dropDuplicates(["session", "seq", "stale_seq"])


def miss_counters(log: DataFrame, key: str, turn: str, query: str, miss) -> DataFrame:
    """(key, misses, hits, last_turn): misses are sticky, hits are the other look-ups."""
    return log.groupBy(F.col(key).alias("key")).agg(F.count_if(miss).alias("misses"), F.count_if(~miss).alias("hits"), F.max(turn).alias("last_turn"))


def rewrite_due(counters: DataFrame, now: int, misses: int = 2, turns: int = 5) -> DataFrame:
    """Entries missed more than `misses` times whose last rewrite is over `turns` turns ago."""
    return counters.where((F.col("misses") > misses) & (F.lit(now) - F.col("last_rewrite") > turns))


def rewrite_anchors(missed: DataFrame, key: str = "key", query: str = "query") -> DataFrame:
    """(key, anchors): the distinct words of three letters or more of an entry's missed queries."""
    rows = missed.select(key, F.explode(F.split(F.lower(query), r"\s+")).alias("w")).where(F.char_length("w") >= 3)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("w")).alias("anchors"))


def rewrite(entries: DataFrame, counters: DataFrame, missed: DataFrame, originals: DataFrame, compress, now: int) -> DataFrame:
    """Entries due for a rewrite, compressed anew from their originals with 0.2 more budget and anchors of the missed queries.

    entries has key, budget and text; originals key and original; the result key, old and new budget, anchors, misses and text.
    """
    due = rewrite_due(counters, now).join(entries, "key").join(originals, "key").join(rewrite_anchors(missed), "key", "left")
    fresh = F.least(F.col("budget") + 0.2, F.lit(1.0))
    return due.select("key", F.col("budget").alias("old_budget"), fresh.alias("new_budget"), F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"), "misses", compress(F.col("original"), fresh).alias("text"))
