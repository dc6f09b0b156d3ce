"""Grouped metrics of episodes, probes, artifacts and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.fidelity import dot


def episode_metrics(episodes: DataFrame, by: list[str], score: str = "score", ratio: str = "compression_ratio", original: str = "original_tokens", compressed: str = "compressed_tokens") -> DataFrame:
    """Means, population deviations and sums of episodes; rows with an error are counted apart."""
    good = F.col("error").isNull() if "error" in episodes.columns else F.lit(True)
    v = lambda c: F.when(good, F.col(c))
    return episodes.groupBy(*by).agg(F.count(v(score)).alias("episodes"), F.count_if(~good).alias("errors"), F.avg(v(score)).alias("mean_score"), F.coalesce(F.stddev_pop(v(score)), F.lit(0.0)).alias("std_score"), F.avg(v(ratio)).alias("mean_ratio"), F.sum(v(original)).cast("long").alias("original_tokens"), F.sum(v(compressed)).cast("long").alias("compressed_tokens"))


def two_level_mean(scores: DataFrame, outer: list[str], inner: str, score: str) -> DataFrame:
    """The mean of the means of inner groups."""
    return scores.groupBy(*outer, inner).agg(F.avg(score).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("mean_of_means"), F.count("*").alias("groups"))


def probe_table(scores: DataFrame, session: str, probe: str, score: str, probes: list[str]) -> DataFrame:
    return scores.groupBy(session).pivot(probe, probes).agg(F.avg(score))


def artifact_score(found: DataFrame, truth: DataFrame, key: str = "artifact", words: Column | None = None) -> DataFrame:
    """One row: hits, recall, precision (over `words` if given, else over what was found) and F1."""
    f, t = found.select(key).distinct(), truth.select(key).distinct()
    hits = f.join(t, key, "left_semi").agg(F.count("*").alias("hits"))
    n_found, n_truth = f.agg(F.count("*").alias("found")), t.agg(F.count("*").alias("truth"))
    row = hits.crossJoin(n_found).crossJoin(n_truth)  # one row each
    recall = F.when(F.col("truth") > 0, F.col("hits") / F.col("truth")).otherwise(0.0)
    precision = F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(0.0)
    row = row.withColumn("recall", recall).withColumn("precision", precision)
    return row.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0))


def separation(pairs: DataFrame, label: str = "label", left: str = "original_vec", right: str = "compressed_vec", order: str = "pair_id", first: int = 50) -> DataFrame:
    """The mean distance of lossy pairs over that of faithful ones, of the first rows of each label."""
    from lumenfold.functions.fidelity import epe

    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("_n") <= first)
    d = epe(F.col(left), F.col(right))
    return ranked.agg((F.avg(F.when(F.col(label) != "faithful", d)) / F.avg(F.when(F.col(label) == "faithful", d))).alias("separation"))


def pair_summary(pairs: DataFrame, by: str = "strategy", left: str = "original_vec", right: str = "compressed_vec") -> DataFrame:
    return pairs.groupBy(by).agg(F.count("*").alias("pairs"), F.avg(dot(F.col(left), F.col(right))).alias("mean_cosine"))
