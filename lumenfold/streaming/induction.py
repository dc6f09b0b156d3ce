"""The queue of artifacts that no schema fits: written as a table, drained by a stream whose checkpoint holds what was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.operators import induce


def enqueue(artifacts: DataFrame, path: str) -> None:
    """Add artifacts (artifact_id, artifact) to the queue."""
    artifacts.select("artifact_id", "artifact").write.mode("append").parquet(path)


def drain(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_at_once: int | None = None) -> None:
    """handle(artifacts, batch) for all that was queued since the last drain on this checkpoint; each is in one batch.

    A batch that failed is handed out again under its number, so a handle that replaces what it wrote under it does its work once.
    """
    rows = spark.readStream.schema("artifact_id long, artifact string")
    rows = rows.option("maxFilesPerTrigger", files_at_once) if files_at_once else rows
    rows.parquet(path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def induce_to(path: str, most: float = 0.30, least: int = 5) -> Callable[[DataFrame, int], None]:
    """A handle that induces families of a batch and writes their fields, (batch_id, family, field, share, required); artifacts of no family are queued no more."""

    def handle(artifacts: DataFrame, batch_id: int) -> None:
        made = induce.induced_fields(induce.families(artifacts, most, least))
        made.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return handle
