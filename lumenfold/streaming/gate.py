"""Streams: the per-session novelty gate, replay events and time windows."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.functions import fidelity, text as T
from lumenfold.operators.gate import MEMORY, admit


def stream_gate(segments: DataFrame, threshold: float = 0.05, session: str = "session_id", seq: str = "seq", text: str = "text", dim: int = 64) -> DataFrame:
    """(session, seq, novel, score) of a stream; state is a session's seen tokens and last admitted vectors.

    With segments in order it decides as the batch gate does.
    """
    rows = segments.select(F.col(session).cast("string").alias("session"), F.col(seq).cast("long").alias("seq"), T.key_tokens(F.col(text)).alias("tokens"), fidelity.hashed_encoding(F.col(text), dim).alias("vector"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, recent = set(), deque(maxlen=MEMORY)
        if state.exists:
            old, vectors = state.get
            seen, recent = set(json.loads(old)), deque(map(np.array, json.loads(vectors)), maxlen=MEMORY)
        frame = pd.concat(list(frames)).sort_values("seq")
        out = []
        first = not state.exists
        for tokens, v in zip(frame["tokens"], frame["vector"], strict=True):
            vector = None if v is None else np.asarray(v, dtype=float)
            fresh = bool(set(tokens) - seen)
            out += admit([vector], [fresh or first and not len(tokens)], threshold, recent)
            seen, first = seen | set(tokens), False
        state.update((json.dumps(sorted(seen)), json.dumps([v.tolist() for v in recent])))
        yield pd.DataFrame({"session": key[0], "seq": frame["seq"], "novel": [y for y, _ in out], "score": [s for _, s in out]})

    return rows.groupBy("session").applyInPandasWithState(run, "session string, seq long, novel boolean, score double", "seen string, recent string", "append", GroupStateTimeout.NoTimeout)


def replay_events(decisions: DataFrame, contradictions: DataFrame | None = None, late: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """Decisions as the events that a viewer gets: a start, the ingest, and its completion, in order.

    Besides, where given, a contradiction for each entry that a segment makes stale (session, seq, stale_seq), a timeout instead of the
    completion of what was late (session, seq), and with `totals` the session's counts behind its last segment.
    """
    steps = ("start", "ingest", "contradiction", "complete", "timeout", "stats")
    kinds = F.array(*[F.struct(F.lit(steps.index(k)).alias("step"), F.lit(k).alias("type")) for k in ("start", "ingest", "complete")])
    action = F.when(F.col("novel"), "hot").otherwise("cold_only").alias("action")
    out = decisions.select("session", "seq", "novel", F.explode(kinds).alias("e")).select("session", "seq", "e.step", "e.type", action)

    def more(rows: DataFrame, kind: str, what) -> DataFrame:
        return rows.select("session", "seq", F.lit(steps.index(kind)).alias("step"), F.lit(kind).alias("type"), what.alias("action"))

    if late is not None:
        gone = late.select("session", "seq").distinct()
        done = out.where("type = 'complete'").join(gone, ["session", "seq"], "left_anti")
        out = out.where("type <> 'complete'").unionByName(done).unionByName(more(gone, "timeout", F.lit("late")))
    if contradictions is not None:
        out = out.unionByName(more(contradictions, "contradiction", F.concat(F.lit("stale "), F.col("stale_seq").cast("string"))))
    if totals:
        sums = decisions.groupBy("session").agg(F.max("seq").alias("seq"), F.count_if("novel").alias("hot"), F.count("*").alias("all"))
        out = out.unionByName(more(sums, "stats", F.concat_ws(" of ", F.col("hot").cast("string"), F.col("all").cast("string"))))
    return out


def newly_stale(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that are stale now and were not before."""
    return after.where("stale").join(before.where("stale"), keys, "left_anti")


#: Lines of a block of the running sum of delays.
BLOCK_LINES = 100_000


def with_event_time(replay: DataFrame, start: str = "2024-01-01 00:00:00", speed: float = 1.0, order: str = "line") -> DataFrame:
    """Replay lines with the time they come at: the sum of delays so far over the speed."""
    from pyspark.sql import Window

    # sums in two levels: of lines within a block, and of whole blocks before it, of which there are few
    rows = replay.withColumn("_block", F.floor(F.col(order) / BLOCK_LINES))
    blocks = rows.groupBy("_block").agg(F.sum("delay_seconds").alias("_sum"))
    blocks = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    past = F.sum("delay_seconds").over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    timed = rows.withColumn("_past", past).join(blocks, "_block")
    return timed.withColumn("event_time", (F.lit(start).cast("timestamp").cast("double") + (F.col("_before") + F.col("_past")) / speed).cast("timestamp")).select(*replay.columns, "event_time")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time_col: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions by key with a gap, for streams (with a watermark) and tables alike."""
    timed = events.withColumn("_t", F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    return timed.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
