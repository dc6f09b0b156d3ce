"""Rewrites of hot entries that questions keep missing: when they are due, and the swap.

An entry is looked up turn by turn. Misses are counted (hits never undo them); as soon as there are more than `misses` and
the last rewrite is more than `gap` turns ago, the entry is rewritten and the count begins anew. The words of all
its missed questions so far become anchors. `streaming.rewrite` decides the same with state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.ordered import keyed_fold, kinds_of

MISSES, GAP = 2, 5


class Counter:
    """One entry's count: misses since the last rewrite, its turn, how many there were, and the words of missed questions in order."""

    def __init__(self, misses: int = 0, last: int | None = None, done: int = 0, words: list[str] | None = None) -> None:
        self.misses, self.last, self.done, self.words = misses, last, done, dict.fromkeys(words or ())

    def missed(self, query: str | None) -> None:
        self.misses += 1
        self.words |= dict.fromkeys(w for w in (query or "").lower().split() if len(w) >= 3)

    def due(self, turn: int, misses: int, gap: int) -> int | None:
        """The misses that make a rewrite due at this turn, None if it isn't; the count begins anew."""
        if self.misses <= misses or self.last is not None and turn - self.last <= gap:
            return None
        count, self.misses, self.last, self.done = self.misses, 0, turn, self.done + 1
        return count


def schedule(log: DataFrame, key: str, turn: str, query: str, miss: Column, misses: int = MISSES, gap: int = GAP) -> DataFrame:
    """(key, turn, nth, misses, anchors): every rewrite of every entry of a log of look-ups.

    Turns of an entry are taken in order, a turn's rows by their question. Rows without a key or turn take no part.
    """
    rows = log.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.col(query).cast("string").alias("query"), F.coalesce(miss, F.lit(False)).alias("miss")).where("key IS NOT NULL AND turn IS NOT NULL")

    def start():
        held = Counter()

        def step(row: dict) -> list[tuple]:
            if row["miss"]:
                held.missed(row["query"])
            count = held.due(row["turn"], misses, gap)
            return [] if count is None else [(row["key"], row["turn"], held.done, count, list(held.words))]

        return step

    return keyed_fold(rows, ["key"], ["turn", "query"], start, f"{kinds_of(rows, 'key')}, turn long, nth int, misses int, anchors array<string>")


def swapped(entries: DataFrame, rewrites: DataFrame, originals: DataFrame, compress: Callable[[Column, Column, Column], Column], encode: Callable[[Column], Column], distance: Callable[[Column, Column], Column], more: float = 0.2) -> DataFrame:
    """entries (key, text, budget, vector, score and others) after the rewrites; a rewritten entry has a new text, vector, score and budget, and the mark `rewritten`.

    Each rewrite adds `more` to the budget, up to 1; the last one of an entry makes its text, from the original (key, original) by
    compress(original, budget, anchors). The new score is the distance of both encodings alone. Entries
    whose original is not there stay as they are, as do those without a rewrite.
    """
    last = rewrites.groupBy("key").agg(F.max_by(F.struct("nth", "anchors"), "nth").alias("_last"))
    met = entries.join(last, "key", "left").join(originals.select("key", F.col("original").alias("_original")), "key", "left")
    on = F.col("_last").isNotNull() & F.col("_original").isNotNull()
    budget = F.when(on, F.least(F.col("budget") + more * F.col("_last.nth"), F.lit(1.0))).otherwise(F.col("budget"))
    met = met.withColumn("budget", budget).withColumn("text", F.when(on, compress(F.col("_original"), F.col("budget"), F.col("_last.anchors"))).otherwise(F.col("text")))
    met = met.withColumn("vector", F.when(on, encode(F.col("text"))).otherwise(F.col("vector"))).withColumn("score", F.when(on, distance(encode(F.col("_original")), F.col("vector"))).otherwise(F.col("score")))
    return met.select(*entries.columns, on.alias("rewritten"))
