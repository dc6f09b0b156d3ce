"""The novelty gate and the write path of a session memory.

A segment is admitted if it has a key token that its session has not seen. Seen tokens
only grow with admitted segments, and a segment with an unseen token always is
admitted, so "unseen" is "first occurrence in the session": a minimum, without state.
Only the rest is compared with the last admitted vectors, one session at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import fidelity, text as T
from lumenfold.operators.compress import ladder
from lumenfold.operators.ordered import keyed_fold, kinds_of

MEMORY = 50


def first_seen(segments: DataFrame, session: str = "session_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """(session, seq, tokens, new_tokens) of each segment: its key tokens, and those that no earlier one has. A token's first segment is a minimum, combined before the shuffle."""
    rows = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), T.key_tokens(F.col(text)).alias("held"))
    tokens = rows.select("session", "seq", F.explode_outer("held").alias("token")).where("token IS NOT NULL")
    first = tokens.groupBy("session", "token").agg(F.min("seq").alias("seq")).groupBy("session", "seq").agg(F.count("*").alias("new_tokens"))
    known = rows.select("session", "seq", F.coalesce(F.size("held"), F.lit(0)).cast("long").alias("tokens"))
    return known.join(first, ["session", "seq"], "left").select("session", "seq", "tokens", F.coalesce("new_tokens", F.lit(0)).alias("new_tokens"))


def admit(vectors: Iterable[np.ndarray | None], sure: Iterable[bool], threshold: float, recent: deque) -> Iterator[tuple[bool, float]]:
    """Decisions in order: sure ones are admitted; others by their distance to the nearest of the last admitted."""
    for v, known in zip(vectors, sure, strict=True):
        if known or not recent or v is None:
            yes, score = True, 1.0
        else:
            score = 1.0 - float((np.array(recent) @ v).max())
            yes = score > threshold
        if yes and v is not None:
            recent.append(v)
        yield yes, score


def novelty_gate(segments: DataFrame, threshold: float = 0.05, session: str = "session_id", seq: str = "seq", text: str = "text", vector: str = "vector") -> DataFrame:
    """(session, seq, novel, score). Each decision follows from those before it: a session's sorted segments stream by, and the last admitted vectors are all that is held."""
    seen = first_seen(segments, session, seq, text)
    rows = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(vector).alias("vector")).join(seen, ["session", "seq"])

    def start():
        recent: deque = deque(maxlen=MEMORY)
        begun: list[bool] = []

        def step(row: dict) -> list[tuple]:
            v = None if row["vector"] is None else np.asarray(row["vector"], dtype=float)
            # a segment without key tokens is admitted for that only where it is its session's first
            sure = row["new_tokens"] > 0 or not begun and row["tokens"] == 0
            begun[:] = [True]
            return [(row["session"], row["seq"], *map(_plain, decision)) for decision in admit([v], [sure], threshold, recent)]

        return step

    return keyed_fold(rows, ["session"], ["seq"], start, f"{kinds_of(rows, 'session', 'seq')}, novel boolean, score double")


def _plain(x):
    return x.item() if isinstance(x, np.generic) else x


def ingest(segments: DataFrame, threshold: float = 0.05, schema_threshold: float = 0.5, session: str = "session_id", seq: str = "seq", text: str = "text", dim: int = 64, alpha: float = 0.5, references: int = 3) -> DataFrame:
    """The write path of a batch, a row for each segment: decision, schema, budget, committed text and its scores.

    Admitted segments write their facts; one that names an entity written `references` times by then, or an
    artifact, keeps all. What is new to all schemas is queued for induction (and committed all the same).
    Segments that are not novel stay in cold storage only: they write no facts, and their scores are null.
    """
    from lumenfold.operators.memory import references as referenced

    coded = segments.withColumn("vector", fidelity.hashed_encoding(F.col(text), dim))
    gate = novelty_gate(coded, threshold, session, seq, text)
    body = F.col(text)
    joined = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), body.alias("original")).join(gate, ["session", "seq"])
    most = referenced(joined.where("novel"), "session", "seq", "original")
    by_kind = lambda make: F.coalesce(*[F.when(F.col("schema") == k, make(k)) for k in T.P.SCHEMA_TYPES], F.lit(0.0))
    far = lambda a, b: fidelity.cosine_distance(fidelity.hashed_encoding(a, dim), F.coalesce(fidelity.hashed_encoding(b, dim), F.array_repeat(F.lit(0.0), dim)))
    original, hot = F.col("original"), F.col("action") == "hot"
    made = joined.join(most, ["session", "seq"], "left").select("session", "seq", F.when(F.col("novel"), "hot").otherwise("cold_only").alias("action"), F.col("score").alias("novelty"), T.detect_schema(original).alias("schema"), (T.schema_novelty(original) > schema_threshold).alias("schema_novel"), F.coalesce("most", F.lit(0)).cast("long").alias("references"), "original")
    keep_all = T.is_artifact(original) | (F.col("references") >= references)
    made = made.withColumn("queued", hot & F.col("schema_novel")).withColumn("budget", F.when(hot, fidelity.write_budget(F.lit("BACKGROUND"), by_kind(lambda k: T.schema_gap(original, k)), keep_all, alpha)))
    lost = lambda a, b: by_kind(lambda k: T.schema_gap_pair(a, b, k))
    made = made.withColumn("committed", F.when(hot, ladder(original, F.col("budget"), T.truncate, far, lost)))
    made = made.withColumn("cosine_epe", F.when(hot, far(original, F.col("committed")))).withColumn("gap", F.when(hot, lost(original, F.col("committed"))))
    made = made.withColumn("combined", F.when(hot, fidelity.combined_epe(F.col("cosine_epe"), F.col("gap"), alpha))).withColumn("r_build", F.when(hot, fidelity.r_build(F.col("cosine_epe"), F.col("gap"))))
    return made.withColumn("tokens", T.token_count(original)).withColumn("kept_tokens", F.when(hot, T.token_count(F.col("committed"))))


def dump(hot: DataFrame, session: str = "session", seq: str = "seq", text: str = "committed") -> DataFrame:
    """(session, memory): the hot texts as numbered lines, in order."""
    rows = hot.where(F.col(text).isNotNull()).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("q"), F.col(text).alias("t")))).alias("x"))
    return rows.select(session, F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["q"].cast("string"), F.lit("] "), r["t"])), "\n").alias("memory"))
