"""Sources and sinks: episodes, issues, replays, logs and results."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

EPISODE = "episode_id string, task string, domain string, task_type string, source string, success boolean, num_turns int, total_tokens int, trajectory string, qa_pairs string"
TURNS = "array<struct<turn_idx int, action string, observation string>>"
QUESTIONS = "array<struct<question string, answer string, question_uuid string, type string>>"
RESULT = "episode_idx int, episode_id string, domain string, score double, n_questions int, per_question array<struct<question_uuid string, type string, question string, answer string, score double, reasoning string>>, compression_ratio double, original_tokens bigint, compressed_tokens bigint, error string, traceback string"
REPLAY = "text string, delay_seconds double"


def episodes(spark: SparkSession, path: str, domain: str | None = None, most: int | None = None) -> DataFrame:
    """Episodes of JSON lines; trajectory and qa_pairs may be nested or JSON in a string."""
    rows = spark.read.schema(EPISODE).json(path).withColumn("trajectory", F.from_json("trajectory", TURNS)).withColumn("qa_pairs", F.from_json("qa_pairs", QUESTIONS))
    rows = rows if domain in (None, "all") else rows.where(F.col("domain") == domain)
    return rows if most is None else rows.orderBy("episode_id").limit(most)


def episode_segments(rows: DataFrame, most_chars: int = 800) -> DataFrame:
    """(session_id, turn, role, text): an action and an observation for each turn, empty ones left out."""
    turns = rows.select(F.col("episode_id").alias("session_id"), F.posexplode("trajectory").alias("i", "t"))
    both = turns.select("session_id", F.explode(F.array(F.struct((F.col("i") * 2).alias("turn"), F.lit("assistant").alias("role"), F.col("t.action").alias("text")), F.struct((F.col("i") * 2 + 1).alias("turn"), F.lit("tool").alias("role"), F.col("t.observation").alias("text")))).alias("s"))
    return both.select("session_id", "s.turn", "s.role", F.substring("s.text", 1, most_chars).alias("text")).where("text IS NOT NULL AND text <> ''")


def episode_lines(rows: DataFrame, most_chars: int = 600) -> DataFrame:
    """(session_id, lines, original_tokens): a trajectory as text."""
    seg = episode_segments(rows, most_chars)
    line = F.concat_ws(": ", F.when(F.col("role") == "assistant", "Action").otherwise("Observation"), F.col("text"))
    return seg.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).cast("long").alias("original_tokens"))


def episode_at(rows: DataFrame, index: int, order: str = "episode_id") -> DataFrame:
    """The episode at a place of the order; an error past the end."""
    got = rows.orderBy(order).offset(index).limit(1)
    if got.isEmpty():
        raise IndexError(f"there is no episode {index}")
    return got


def issues(spark: SparkSession, path: str) -> DataFrame:
    """Two segments an issue: the problem (user, 0) and its patch (assistant, 1)."""
    rows = spark.read.schema("instance_id string, problem_statement string, patch string").json(path)
    return rows.select(F.col("instance_id").alias("session_id"), F.stack(F.lit(2), F.lit(0), F.lit("user"), F.col("problem_statement"), F.lit(1), F.lit("assistant"), F.col("patch")).alias("turn", "role", "text"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Replay lines (blank ones left out)."""
    return spark.read.schema(REPLAY).json(path).where("text IS NOT NULL")


def replay_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(REPLAY).option("maxFilesPerTrigger", files_at_once).json(folder).where("text IS NOT NULL")


def labelled_pairs(spark: SparkSession, path: str, label: str) -> DataFrame:
    rows = spark.read.schema("compressed string, original string, label string, strategy string").json(path).where(F.col("label") == label)
    if rows.isEmpty():
        raise ValueError(f"no pairs labelled {label!r} in {path}")
    return rows


def results(spark: SparkSession, path: str, domain: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episode results: of the domain, with errors (of any domain), and of other domains."""
    rows = spark.read.schema(RESULT).option("multiLine", True).json(path)
    bad = F.col("error").isNotNull()
    mine = F.lit(True) if domain in (None, "all") else F.col("domain") == domain
    return rows.where(~bad & mine), rows.where(bad), rows.where(~bad & ~mine)


def query_log_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp string, session_id string, query string, query_type string").json(path).groupBy("query_type").count()


def append(rows: DataFrame, path: str, form: str = "json") -> None:
    """Add rows to a log or to cold storage."""
    rows.write.mode("append").format(form).save(path)


def cold_rows(segments: DataFrame, session: str = "session_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Rows of cold storage: the original, when it came and its tokens."""
    from lumenfold.functions.text import token_count

    return segments.select(F.col(session).alias("session_id"), F.col(seq).alias("seq_id"), F.col(text).alias("content"), F.current_timestamp().alias("timestamp_utc"), token_count(F.col(text)).alias("token_count"))


def write_results(rows: DataFrame, path: str) -> None:
    """Results as rows, errors too (columns error and traceback)."""
    rows.write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> str:
    """Write a summary without replacing one: a time is added to the name if it exists. Returns the path."""
    jvm = summary.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(summary.sparkSession._jsc.hadoopConfiguration()).exists(at):
        path = f"{path}_{time.strftime('%Y%m%d_%H%M%S')}"
    summary.write.mode("errorifexists").json(path)
    return path


def write_pairs(pairs: DataFrame, path: str, seed: int = 7) -> None:
    """Training pairs in a seeded random order, without the working column."""
    out = pairs.drop("_cos_sim")
    out.orderBy(F.rand(seed)).write.mode("overwrite").json(path)


def broadcast_events(stream: DataFrame, send) -> DataStreamWriter:
    """Each micro-batch to `send(frame, batch_id)`; the caller starts it."""
    return stream.writeStream.foreachBatch(send)
