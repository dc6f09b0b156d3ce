"""Schema induction: signatures of artifacts, families by shared fields, and fields by frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import key_style, nesting_depth, value_type
from lumenfold.operators.ordered import stage

_JSON_KEY, _PAIR = r'"([^"]+)"\s*:', r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*[:=]\s*([^,\n}]+)"


def field_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(_JSON_KEY), 1), F.regexp_extract_all(text, F.lit(_PAIR), 1))))


def signature(text: Column) -> Column:
    """A struct of sorted field names, value types, nesting depth and key styles."""
    names = field_names(text)
    seen = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), 2), value_type)
    hints = F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in (("boolean", r"\b(true|false)\b"), ("null", r"\bnull\b"), ("number", r"\b[0-9]+\b"), ("string", r'"[^"]+"'))]))
    return F.struct(names.alias("fields"), F.array_sort(F.array_distinct(F.concat(seen, hints))).alias("types"), nesting_depth(text).alias("depth"), F.array_sort(F.array_distinct(F.transform(names, key_style))).alias("styles"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """0 for two empty sets, 1 if one is empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / both.cast("double"))


def field_sets(artifacts: DataFrame, id_col: str = "artifact_id", text_col: str = "artifact") -> DataFrame:
    """(fields, members, first): each distinct set of fields, which stands for all its artifacts."""
    return artifacts.select(F.col(id_col).alias("id"), field_names(F.col(text_col)).alias("fields")).groupBy("fields").agg(F.count("*").alias("members"), F.min("id").alias("first"))


def close_sets(sets: DataFrame, most: float = 0.30) -> DataFrame:
    """(a, b, distance): first artifacts of different sets at most `most` apart; only sets that share a field meet.

    Sets that close share one of their rarest fields, so a field that all sets have makes no pairs:
    of a set of n, all but ceil((1 - most) n) - 1 fields are looked up, from the rarest on.
    """
    named = sets.select("first", "fields", F.explode("fields").alias("field"))
    often = named.groupBy("field").agg(F.count("*").alias("n"))
    ordered = named.join(often, "field").groupBy("first", "fields").agg(F.sort_array(F.collect_list(F.struct("n", "field"))).alias("order"))
    size = F.size("fields")
    some = F.slice("order", F.lit(1), (size - F.ceil((1 - most) * size - 1e-9) + 1).cast("int"))
    cut = ordered.select("first", "fields", F.explode(some).alias("x")).select("first", "fields", F.col("x.field").alias("field"))
    one = cut.select(F.col("first").alias("a"), F.col("fields").alias("fa"), "field")
    two = cut.select(F.col("first").alias("b"), F.col("fields").alias("fb"), "field")
    met = one.join(two, "field").where("a < b").dropDuplicates(["a", "b"])
    return met.withColumn("distance", jaccard_distance(F.col("fa"), F.col("fb"))).where(F.col("distance") <= most).select("a", "b", "distance")


def families(artifacts: DataFrame, most: float = 0.30, least: int = 5, id_col: str = "artifact_id", text_col: str = "artifact", rounds: int = 30) -> DataFrame:
    """(id, family): single linkage, that is connected components of close field sets; families of `least` artifacts or more.

    Labels are the smallest first artifact; each round a set takes the least label around it and
    then the label of its label, so chains shorten by doubling, until none changes. Labels that
    have not settled after `rounds` are an error. Work is by distinct sets, which are few beside the artifacts.
    """
    sets = stage(field_sets(artifacts, id_col, text_col))
    links = close_sets(sets, most).select("a", "b")
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = sets.select(F.col("first").alias("node"), F.col("first").alias("family"))
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("family").alias("around"))
        near = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("family").alias("was"), F.least("family", "around").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("family").alias("up"))
        moved = stage(near.join(up, "near", "left").select("node", "was", F.least("near", "up").alias("family")))
        labels = moved.select("node", "family")
        if moved.where("family <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"families did not settle in {rounds} rounds")
    rows = artifacts.select(F.col(id_col).alias("id"), field_names(F.col(text_col)).alias("fields"))
    out = rows.join(sets, "fields").join(labels, F.col("first") == F.col("node")).select("id", "family", "fields")
    size = out.groupBy("family").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return out.join(size, "family").select("id", "family", "members", "fields")


def induced_fields(members: DataFrame, required: float = 0.8, optional: float = 0.2) -> DataFrame:
    """(family, field, share, required) of fields that enough members (family, members, fields) have."""
    long = members.select("family", "members", F.explode("fields").alias("field")).groupBy("family", "members", "field").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("members").cast("double")
    return long.select("family", "field", share.alias("share"), (share >= required).alias("required")).where(F.col("share") >= optional)


def value_patterns(artifacts: DataFrame, text_col: str = "artifact") -> DataFrame:
    """(field, pattern): a pattern that stands for a field's values: digits, boolean, path, up to three alternatives, or anything."""
    pairs = artifacts.select(F.explode(F.arrays_zip(F.regexp_extract_all(text_col, F.lit(_PAIR), 1).alias("k"), F.regexp_extract_all(text_col, F.lit(_PAIR), 2).alias("v"))).alias("p"))
    values = pairs.select(F.col("p.k").alias("field"), F.trim(F.trim(F.trim("p.v")), F.lit("\"'")).alias("value"))
    seen = values.groupBy("field").agg(F.every(F.col("value").rlike("^-?[0-9]+$")).alias("digits"), F.every(F.lower("value").isin("true", "false")).alias("booleans"), F.every(F.col("value").contains("/")).alias("paths"), F.count_distinct("value").alias("n"), F.array_sort(F.slice(F.array_sort(F.collect_set("value")), 1, 3)).alias("some"))
    pattern = F.when(F.col("digits"), r"\d+").when(F.col("booleans"), "true|false").when(F.col("paths"), r"[\w./\-]+").when(F.col("n") <= 3, F.array_join(F.transform("some", lambda v: F.regexp_replace(v, r"([\\.^$|?*+()\[\]{}])", r"\\$1")), "|")).otherwise(".+")
    return seen.select("field", pattern.alias("pattern"))
