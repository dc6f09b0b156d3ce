"""Context reuse: questions take over the context of an earlier one of their session, from a cache of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.ordered import keyed_fold, kinds_of

CACHE, THRESHOLD = 100, 0.85


def context_reuse(questions: DataFrame, session: str = "session", seq: str = "seq", uuid: str = "uuid", vector: str = "vector", threshold: float = THRESHOLD, most: int = CACHE) -> DataFrame:
    """(session, seq, how, source_seq, similarity, evicted_seq): which question's context each question takes, in the order of seq.

    how is 'uuid' where the cache holds that uuid, else 'similar' where the most similar cached question (the earliest of
    equals) is over the threshold, else 'miss': its own context is retrieved and cached, and where the cache is full
    the entry written first goes. A session's sorted rows stream by; only its cache is held. Questions
    without a vector are similar to none. Hits do not change the cache's order.
    """
    rows = questions.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(uuid).cast("string").alias("uuid"), F.col(vector).cast("array<double>").alias("vector"))

    def start():
        cache: dict[str | None, tuple] = {}  # in the order of writing

        def step(row: dict) -> list[tuple]:
            made = (row["session"], row["seq"])
            if row["uuid"] in cache:
                return [(*made, "uuid", cache[row["uuid"]][0], None, None)]
            own = None if row["vector"] is None else np.array(row["vector"])
            able = [] if own is None else [x for x in cache.values() if x[1] is not None]
            if able:
                scores = np.array([x[1] for x in able]) @ own
                best = int(scores.argmax())
                if scores[best] > threshold:
                    return [(*made, "similar", able[best][0], float(scores[best]), None)]
            gone = cache.pop(next(iter(cache)))[0] if len(cache) >= most else None
            cache[row["uuid"]] = (row["seq"], own)
            return [(*made, "miss", row["seq"], None, gone)]

        return step

    kind = kinds_of(rows, "seq").removeprefix("seq ")
    return keyed_fold(rows, ["session"], ["seq"], start, f"{kinds_of(rows, 'session')}, seq {kind}, how string, source_seq {kind}, similarity double, evicted_seq {kind}")


def with_contexts(decisions: DataFrame, questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """decisions with a context: retrieve(questions that missed) gives (session, seq, context), once for all; the others take their source's."""
    missed = questions.join(decisions.where("how = 'miss'").select("session", "seq"), ["session", "seq"], "left_semi")
    found = retrieve(missed).select("session", F.col("seq").alias("source_seq"), "context")
    return decisions.join(found, ["session", "source_seq"], "left")
