"""What viewers of a stream get: token events, and a history that late joiners read before the tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenfold.functions.text import whitespace_tokens


def token_events(committed: DataFrame, session: str = "session", seq: str = "seq", text: str = "text", anchors: str = "anchors") -> DataFrame:
    """(session, seq, pos, token, is_anchor): the tokens of a committed text in order; one is an anchor if it is in `anchors` without the punctuation around it."""
    rows = committed.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.coalesce(anchors, F.array().cast("array<string>")).alias("held"), F.posexplode_outer(whitespace_tokens(F.col(text))).alias("pos", "token")).where("token IS NOT NULL")
    return rows.select("session", "seq", "pos", "token", F.array_contains("held", F.trim("token", F.lit(".,;:!?"))).alias("is_anchor"))


def keep_history(events: DataFrame, path: str) -> DataStreamWriter:
    """Events appended to a table by micro-batch; the caller starts it. A batch that runs again after a failure replaces what it wrote, so nothing is doubled."""

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write)


def history(spark: SparkSession, path: str, schema: str, after: int = -1) -> tuple[DataFrame, int]:
    """(events, last): what batches behind `after` wrote, with their batch_id, and the number of the last of them (`after` if there is none).

    A late joiner reads from the beginning, and then again behind the last batch it has seen; batches are whole or not there.
    """
    known = spark.read.schema(f"{schema}, batch_id long").option("basePath", path).parquet(path).where(F.col("batch_id") > after)
    last = known.agg(F.max("batch_id")).first()[0]
    last = after if last is None else last
    return known.where(F.col("batch_id") <= last), last
