"""Compression: extractive selection, the attempt ladder, the batch compressor and reports."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import fidelity, text as T
from lumenfold.functions.patterns import HIGH_VALUE
from lumenfold.operators.ordered import kinds_of


def sentence_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, sentences, score): tf-idf within the text, and 0.3 for each word of high value.

    A text's tokens meet in its own row, so texts are shuffled once, by id, and no token is. Repeated ids are one text:
    tokens are counted over all of them, sentences of one place are added up.
    """
    cut, token = re.compile(r"(?<=[.!?;])\s+|\n+", re.ASCII), re.compile(r"[a-z0-9_/.]+")

    def score(texts: list[str]) -> list[dict]:
        """The sentences of an id with their base scores; bonuses are told apart by the sentence."""
        parts = [[x for x in (x.strip(" \t\n\x0b\x0c\r") for x in cut.split(t)) if x] for t in texts]
        counts = [[Counter(token.findall(x.lower())) for x in part] for part in parts]
        held = Counter(chain.from_iterable(c for part in counts for c in part))
        made: dict[int, dict] = {}
        for part, count in zip(parts, counts, strict=True):
            whole = [math.log((len(part) + 1) / n) + 1 for n in range(2, max(held.values(), default=0) + 2)]
            for pos, (x, c) in enumerate(zip(part, count, strict=True)):
                own = made.setdefault(pos, {"pos": pos, "sentences": len(part), "score": 0.0, "text": x})
                own["score"] += sum(n * whole[held[t] - 1] for t, n in c.items()) / (c.total() or 1)
        return list(made.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [score(texts) for texts in batch.column("texts").to_pylist()]
            rows = [r for x in made for r in x]
            bonus = pc.count_substring_regex(pa.array([r["text"] for r in rows], pa.string()), HIGH_VALUE).to_numpy(zero_copy_only=False)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made])))
            numbers = [pa.array([r[c] for r in rows], pa.int32()) for c in ("pos", "sentences")]
            yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(np.array([r["score"] for r in rows]) + 0.3 * bonus, pa.float64())], names=["id", "pos", "sentences", "score"])

    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).groupBy("id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    return whole.mapInArrow(run, f"{kinds_of(whole, 'id')}, pos int, sentences int, score double")


def extractive(docs: DataFrame, budget: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, compressed): the best ceil(n * budget) sentences in their order; of one sentence its first words."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if budget <= 0 or budget >= 1:
        return source.select("id", F.col("text").alias("compressed") if budget >= 1 else F.lit("").alias("compressed"))
    ranked = sentence_scores(source, "id", "text").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 6)), "pos")))
    kept = ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("sentences") * budget)))
    kept = kept.groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    both = source.join(kept, "id", "left").withColumn("parts", T.extractive_sentences(F.col("text")))
    many = F.array_join(F.transform("kept", lambda i: F.get(F.col("parts"), i)), " ")
    words = T.whitespace_tokens(F.col("text"))
    one = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(words) * budget).cast("int"))), " ")
    return both.select("id", F.when(F.size("parts") > 1, many).otherwise(F.coalesce(one, F.lit(""))).alias("compressed"))


def with_fallback(docs: DataFrame, model, budget: float, id_col: str = "doc_id", text_col: str = "text", anchors_col: str | None = None) -> DataFrame:
    """(id, compressed, timed_out): a model's answer (`seams.compressor`); extractive compression where the model failed, the text itself where it was late."""
    held = F.col(anchors_col) if anchors_col else F.array().cast("array<string>")
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), model(F.col(text_col), F.lit(budget), held).alias("x"))
    short = extractive(docs, budget, id_col, text_col)
    return told.join(short, "id", "left").select("id", F.when(F.col("x.failed"), F.col("compressed")).otherwise(F.col("x.text")).alias("compressed"), F.col("x.timed_out").alias("timed_out"))


def ladder(text: Column, budget: Column, compress, distance, gap, commit: float = 0.35) -> Column:
    """The first of three attempts (budget, +0.2, +0.4, 1 at most) whose loss is within `commit`; else the text itself.

    compress(text, budget), distance(original, compressed) and gap(original, compressed) are Column functions.
    """
    tries = [F.least(budget + 0.2 * i, F.lit(1.0)) for i in range(3)]
    made = [compress(text, b) for b in tries]
    return F.coalesce(*[F.when(fidelity.r_build(distance(text, m), gap(text, m)) <= commit, m) for m in made], text)


def report(plans: DataFrame, budget: str = "budget") -> DataFrame:
    b = F.col(budget)
    return plans.agg(F.count("*").alias("segments"), F.avg(b).alias("mean_budget"), F.count_if(b >= 0.95).alias("high"), F.count_if(b <= 0.35).alias("low"))


def token_reduction(original: Column, compressed: Column) -> Column:
    return 1 - compressed / F.greatest(original, F.lit(1)).cast("double")


def adaptive(sessions: DataFrame, session: str = "session_id", text_col: str = "text", compress=T.truncate, predict=lambda s: T.truncate(s, 0.5), dim: int = 64) -> DataFrame:
    """(session, text, reduction): sections with a plan each, compressed and joined again.

    A section's raw score is its distance from what `predict` makes of it (by default the section
    without its second half), so sections that say more than their beginnings get more.
    """
    cut = sessions.select(F.col(session).alias("session"), F.posexplode(T.sections(F.col(text_col))).alias("pos", "segment"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    code = lambda t: F.coalesce(fidelity.hashed_encoding(t, dim), zeros)
    raw = cut.withColumn("raw", fidelity.epe(code(predict(F.col("segment"))), code(F.col("segment"))))
    of = raw.groupBy("session").agg(F.avg("raw").alias("mean"), F.stddev_pop("raw").alias("spread"))
    planned = raw.join(of, "session").withColumn("z", (F.col("raw") - F.col("mean")) / F.greatest("spread", F.lit(1e-9)))
    planned = planned.withColumn("budget", fidelity.budget_plan(F.col("z"), F.lit("BACKGROUND"), T.is_artifact(F.col("segment")), F.lit(None).cast("double")))
    small = planned.withColumn("short", F.when(F.col("budget") >= 1, F.col("segment")).otherwise(compress(F.col("segment"), F.col("budget"))))
    total = small.groupBy("session").agg(F.sum(T.token_count(F.col("segment"))).alias("before"), F.sum(T.token_count(F.col("short"))).alias("after"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "short"))), lambda s: s["short"]), "\n").alias("text"))
    return total.select("session", "text", F.greatest(F.lit(0.0), token_reduction(F.col("before"), F.col("after"))).alias("reduction"))


#: Compressors by name: Column functions of text and budget.
BACKENDS = {"truncation": T.truncate, "simple_mem": lambda text, budget: T.truncate(T.dedupe_sentences(text), budget), "llm_lingua": T.truncate}


def backend(name: str):
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[name]
