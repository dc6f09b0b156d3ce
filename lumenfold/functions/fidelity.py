"""Vectors, fidelity scores, confidences and budgets, as Columns."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from lumenfold.functions import patterns as P


def dot(a: Column, b: Column) -> Column:
    """The inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: inside a lambda Catalyst would repeat it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(v: Column) -> Column:
    """A unit vector; a zero vector is an error."""

    def scaled(u: Column) -> Column:
        unit = let(F.sqrt(dot(u, u)), lambda size: F.transform(u, lambda x: x / size))
        return F.when(dot(u, u) == 0, F.raise_error(F.lit("cannot normalise a zero vector")).cast("array<double>")).otherwise(unit)

    return let(v, scaled)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def epe(a: Column, b: Column) -> Column:
    """A quarter of the squared distance: 0 for equal unit vectors, 0.5 for orthogonal ones."""
    return squared_distance(a, b) / 4


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: So many tokens keep their places in a task's memory.
KNOWN = 200_000


def hashed_encoding(text: Column, dim: int = 64) -> Column:
    """The default encoder: counts of lexical tokens by hashed place, as a unit vector; null without tokens.

    A token's place is worked out once and remembered, in bounds; counts are by number, not by looking through the tokens for each place.
    """
    token = re.compile(P.LEXICAL_TOKEN, re.ASCII)
    places: dict[str, int] = {}

    def place(word: str) -> int:
        if len(places) >= KNOWN:
            places.clear()
        at = places[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % dim
        return at

    def encode(texts: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = []
        for t in texts:
            tokens = token.findall(t.as_py()) if t.is_valid else ()
            if not tokens:
                out.append(None)
                continue
            at = [places[x] if x in places else place(x) for x in tokens]
            counts = np.bincount(at, minlength=dim).astype(np.float64)
            out.append(counts / np.sqrt(counts @ counts))
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(encode, "array<double>")(F.lower(text))


def hashed_counts(places: Column, dim: int) -> Column:
    count = lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(ps, lambda p: p == i)).cast("double"))
    return let(places, lambda ps: F.when(F.size(ps) > 0, normalize(count(ps))))


def combined_epe(cosine: Column, gap: Column, alpha: float = 0.5) -> Column:
    return alpha * cosine + (1 - alpha) * gap


def r_build(cosine: Column, gap: Column, predicted: Column | None = None, weights: tuple[float, float, float] = (0.6, 0.4, 0.0)) -> Column:
    predicted = F.lit(0.0) if predicted is None else predicted
    return F.least(F.greatest(weights[0] * cosine + weights[1] * gap + weights[2] * predicted, F.lit(0.0)), F.lit(1.0))


def z_score(x: Column, over: WindowSpec) -> Column:
    return (x - F.avg(x).over(over)) / F.greatest(F.stddev_pop(x).over(over), F.lit(1e-9))


def share(of: Column, within: Column, empty: float = 1.0) -> Column:
    """The share of a set that another one holds; `empty` for an empty set."""
    return F.when(F.size(of) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(of, within)) / F.size(of).cast("double"))


def gate_score(query: Column, context: Column, original: Column) -> Column:
    return F.size(F.array_intersect(query, context)) / F.greatest(F.size(F.array_intersect(query, original)), F.lit(1)).cast("double")


def gate_route(score: Column) -> Column:
    return F.when(score >= 0.7, "hot_cache").when(score >= 0.4, "enriched").otherwise("cold_storage")


def answer_confidence(question: Column, context: Column, answer: Column, trust: Column) -> tuple[Column, Column, Column]:
    """Support, coverage and the weighted confidence, of entity sets."""
    support, cover = share(answer, context), share(question, answer)
    clipped = F.least(F.greatest(trust, F.lit(0.0)), F.lit(1.0))
    return support, cover, F.least(F.greatest(0.5 * support + 0.3 * cover + 0.2 * clipped, F.lit(0.0)), F.lit(1.0))


def by_type(kind: Column, place: int, default: float | None = None) -> Column:
    out = F.lit(P.BUDGETS["BACKGROUND"][place] if default is None else default)
    for name, row in P.BUDGETS.items():
        out = F.when(F.upper(F.trim(kind)) == name, row[place]).otherwise(out)
    return out


def budget_plan(z: Column, kind: Column, artifact: Column, confidence: Column, least: float = 0.30, most: float = 1.0) -> Column:
    """The share to keep: a floor by type, moved by the z-score; all for artifacts. Low confidence pulls the floor to that of BACKGROUND."""
    floor, low = by_type(kind, 0), P.BUDGETS["BACKGROUND"][0]
    floor = F.when(confidence.isNotNull() & (confidence < 0.5), floor * confidence + low * (1 - confidence)).otherwise(floor)
    return F.when(artifact, 1.0).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), floor + by_type(kind, 1) * z)))


def write_budget(kind: Column, gap: Column, keep_all: Column, alpha: float = 0.5, beta: float = 1.0) -> Column:
    """The write path's budget; the cosine part counts as 1."""
    return F.when(keep_all, 1.0).otherwise(F.least(by_type(kind, 2, 0.5) * (1 + beta * (alpha * 1.0 + (1 - alpha) * gap)), F.lit(1.0)))


def eviction_rank(turn: tuple[Column, Column], misses: tuple[Column, Column], hits: tuple[Column, Column], novelty: Column, recency: str = "as_coded") -> Column:
    """Who goes first: higher scores. Each pair is a value and its group's maximum. `recency='age'` lets older entries go first instead of newer ones."""
    part = lambda x: F.when(x[1] > 0, x[0] / x[1].cast("double")).otherwise(0.0)
    time = part(turn) if recency == "as_coded" else 1 - part(turn)
    return 0.3 * time + 0.4 * part(misses) - 0.2 * part(hits) + 0.1 * (1 - novelty)


def risk(epe_value: Column, kind: Column) -> Column:
    """A distance weighted by its content type's risk; types that are not known count half."""
    return epe_value * by_type(kind, 3, 0.5)
