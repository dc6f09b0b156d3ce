"""The co-retrieval graph: an undirected weighted graph of what is retrieved together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.ordered import running_totals


#: Retrieved nodes that a task pairs, about: so many rows' worth of pairs are counted in its memory at a time.
NODES = 500_000


def paired(nodes: DataFrame) -> DataFrame:
    """(call, a, b), a < b, of distinct (call, node): calls are dealt into as many tasks as nodes ask for, however well their shuffled bytes compress."""
    dealt = nodes.repartition(max(1, -(-nodes.count() // NODES)), "call")
    return dealt.withColumnRenamed("node", "a").join(dealt.withColumnRenamed("node", "b"), "call").where("a < b")


def weight(count: Column) -> Column:
    return count / (count + 2).cast("double")


def edges(retrievals: DataFrame, call: str = "call", node: str = "node", cold: str | None = None, cold_step: int = 3) -> DataFrame:
    """(a, b, count, weight), a < b: calls in which both were retrieved; a call with a cold hit counts `cold_step` times."""
    step = F.when(F.max(cold), cold_step).otherwise(1) if cold else F.lit(1)
    steps = retrievals.groupBy(F.col(call).alias("call")).agg(step.alias("step")) if cold else None
    nodes = retrievals.select(F.col(call).alias("call"), F.col(node).alias("node")).distinct()
    pairs = paired(nodes)
    pairs = pairs.join(steps, "call") if cold else pairs.withColumn("step", F.lit(1))
    return pairs.groupBy("a", "b").agg(F.sum("step").cast("long").alias("count")).withColumn("weight", weight(F.col("count")))


def replay(retrievals: DataFrame, call: str = "call", node: str = "node", cold: str | None = None, frozen: Column | None = None, every: int = 50, factor: float = 0.95, least: float = 0.05, cold_step: int = 3) -> DataFrame:
    """(a, b, count, weight) of the graph after all calls in order, with a decay after each `every` of them.

    A call of two nodes or more adds its step to the count of each pair and sets the weight by the count, which undoes decays.
    A decay takes `factor` of every weight; an edge that falls under `least` is deleted with its count, so a later
    call begins it anew. Calls of rows that are `frozen` are no-ops, as are calls of fewer nodes; neither is counted.

    Nothing is looped over calls. Between two decays order doesn't matter, so touches are summed by edge and epoch
    (`every` calls). A gap between epochs so short that no weight dies of it is none: the epochs around it are
    one run. Only an edge's runs, one for each long silence, are folded, in closed form.
    """
    used = retrievals.where(~F.coalesce(frozen, F.lit(False))) if frozen is not None else retrievals
    step = F.when(F.max(cold), cold_step).otherwise(1) if cold else F.lit(1)
    calls = used.groupBy(F.col(call).alias("call")).agg(step.alias("step"), F.count_distinct(F.col(node)).alias("n")).where("call IS NOT NULL AND n > 1")
    numbered = running_totals(calls.select("call", "step"), [], ["call"]).select("call", "step", F.floor(F.col("before") / every).alias("epoch"), F.floor(F.col("total") / every).alias("decays"))
    nodes = used.select(F.col(call).alias("call"), F.col(node).alias("node")).where("node IS NOT NULL").distinct()
    pairs = paired(nodes).join(numbered, "call")
    touched = pairs.groupBy("a", "b", "epoch").agg(F.sum("step").cast("long").alias("step"), F.max("decays").alias("decays"))
    safe = max(0, math.ceil(math.log(least * 3) / math.log(factor)) - 2)  # decays that the least weight, 1/3, surely outlives
    edge = Window.partitionBy("a", "b").orderBy("epoch")
    silent = F.col("epoch") - F.lag("epoch").over(edge) > safe
    runs = touched.withColumn("run", F.count_if(F.coalesce(silent, F.lit(False))).over(edge.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("a", "b", "run").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.sum("step").alias("step"), F.max("decays").alias("decays"))
    each = runs.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("first", "last", "step"))).alias("runs"), F.max("decays").alias("decays"))
    left = lambda count, times: weight(count) * F.pow(F.lit(factor), times.cast("double"))
    fold = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("last")), lambda s, r: F.struct((F.when((s["count"] > 0) & (left(s["count"], r["first"] - s["last"]) >= least), s["count"]).otherwise(0) + r["step"]).alias("count"), r["last"].alias("last")))
    now = each.withColumn("s", fold).select("a", "b", F.col("s.count").alias("count"), left(F.col("s.count"), F.col("decays") - F.col("s.last")).alias("weight"))
    return now.where(F.col("weight") >= least)


def decay(graph: DataFrame, times: int = 1, factor: float = 0.95, least: float = 0.05) -> DataFrame:
    """Weights after `times` decays; edges under `least` go. Counts stay, so a new retrieval undoes it."""
    for _ in range(times):
        graph = graph.withColumn("weight", F.col("weight") * factor).where(F.col("weight") >= least)
    return graph


def neighbors(graph: DataFrame, nodes: DataFrame | None = None, k: int = 3, least: float = 0.2, node: str = "node") -> DataFrame:
    """(node, rank, neighbor, weight): the k heaviest edges of each node; equal weights go to smaller neighbours."""
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("neighbor"), "weight").unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("neighbor"), "weight"))
    both = both.where(F.col("weight") >= least)
    if nodes is not None:
        both = both.join(nodes.select(F.col(node).alias("node")).distinct(), "node", "left_semi")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "neighbor")))
    return ranked.where(F.col("rank") <= k).select("node", "rank", "neighbor", "weight")


def edge_weight(pairs: DataFrame, graph: DataFrame) -> DataFrame:
    """pairs (a, b) in any order with their weight, 0 where there is no edge."""
    keyed = pairs.withColumn("_a", F.least("a", "b")).withColumn("_b", F.greatest("a", "b"))
    found = graph.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("weight"))
    return keyed.join(found, ["_a", "_b"], "left").select(*pairs.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"))
