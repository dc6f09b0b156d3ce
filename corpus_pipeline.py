"""A corpus pipeline over the operators of lumenfold.llm.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns the documents
that are left, in the same columns. The last one returns, for each document left, its ids
and what encoding and decoding give. `run` writes each stage's result to the shared folder and
reads it again, as a job that may lose executors does.

Defined results: see the operators' own docstrings; empty tables go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, decontaminate, langid, line_dedup, minhash
from lumenfold.llm.common import materialize, table
from lumenfold.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter go. A missing lang is filled in."""
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    found = langid.identify(docs, model, out_col="_cp_language").where("_cp_language.lang <> 'und'")
    return found.select(*[F.coalesce("lang", "_cp_language.lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs)
    return left.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more) the document with the smallest id."""
    ship(spark)
    return minhash.keep_first(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    ship(spark)
    slim = docs.select("doc_id", "lang", "source", "text")
    coded = bpe.encode_decode(slim, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode_tokens),
]

#: The near-copy and language stages are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
