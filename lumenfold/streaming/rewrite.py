"""The rewrites of `operators.rewrites` over a stream of look-ups, with state that a restart finds again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators.rewrites import GAP, MISSES, Counter

#: What transformWithStateInPandas needs of a session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "key string, kind string, turn long, nth int, misses int, anchors array<string>"


class Rewriter(StatefulProcessor):
    """State of an entry: its count (a value), its missed questions (a list) and their words by place (a map).

    Questions and words are forgotten `ttl_ms` after their last write. An entry that no look-up
    names for `idle_ms` gives one row of kind 'idle', and its state goes.
    """

    def __init__(self, misses: int, gap: int, idle_ms: int | None, ttl_ms: int | None) -> None:
        self.misses, self.gap, self.idle_ms, self.ttl_ms = misses, gap, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "misses int, last long, done int, turn long")
        self.questions = handle.getListState("questions", "query string", self.ttl_ms)
        self.words = handle.getMapState("words", "word string", "place int", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        misses, last, done, _ = self.count.get() if self.count.exists() else (0, None, 0, None)
        known = sorted((p[0], w[0]) for w, p in self.words.iterator())
        held = Counter(misses, last, done, [w for _, w in known])
        frame = pd.concat(list(rows)).sort_values(["turn", "query"], kind="stable", na_position="first")
        out, missed = [], []
        for turn, query, miss in zip(frame["turn"], frame["query"], frame["miss"], strict=True):
            if miss:
                held.missed(query)
                missed.append((query,))
            count = held.due(int(turn), self.misses, self.gap)
            if count is not None:
                out.append((key[0], "rewrite", int(turn), held.done, count, list(held.words)))
        self.count.update((held.misses, held.last, held.done, int(frame["turn"].max())))
        if missed:
            self.questions.appendList(missed)
            for place, word in enumerate(held.words):
                if place >= len(known) or self.ttl_ms:
                    self.words.updateValue((word,), (place,))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "kind", "turn", "nth", "misses", "anchors"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        misses, _, done, turn = self.count.get()
        asked = [q[0] for q in self.questions.get()]
        for state in (self.count, self.questions, self.words):
            state.clear()
        yield pd.DataFrame([(key[0], "idle", turn, done, misses, asked)], columns=["key", "kind", "turn", "nth", "misses", "anchors"])

    def close(self) -> None:
        pass


def stream_rewrites(log: DataFrame, key: str, turn: str, query: str, miss: Column, misses: int = MISSES, gap: int = GAP, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(key, kind, turn, nth, misses, anchors) of a stream of look-ups: its rewrites, and with `idle_ms` what went idle (anchors: its missed questions).

    Batches are taken in order, rows of a batch by turn and question. The session needs STORE.
    """
    spark = log.sparkSession
    if spark.conf.get(STORE[0], None) != STORE[1]:
        raise RuntimeError(f"set {STORE[0]} to {STORE[1]}")
    rows = log.select(F.col(key).cast("string").alias("key"), F.col(turn).cast("long").alias("turn"), F.col(query).cast("string").alias("query"), F.coalesce(miss, F.lit(False)).alias("miss")).where("key IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(Rewriter(misses, gap, idle_ms, ttl_ms), SCHEMA, "Append", "ProcessingTime" if idle_ms or ttl_ms else "None")
