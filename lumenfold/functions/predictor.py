"""A predictor head: a stack of transformer layers, normalised before each part, that maps a vector into another encoder's space.

Weights are a table of (name, shape, values), as a training job would write it. Their number depends
on the model alone; `load` refuses more than `MOST` values, and one broadcast carries them to the executors.
Texts of one vector pass as a sequence of one; sequences attend to themselves, row by row and batch by batch.

Defined results: null vectors, empty ones and those of another length than the model's give null. Entries that
are null or not finite give null too. An output of length zero stays zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A model of more values is not loaded.
MOST = 64_000_000
HEADS, LAYERS, HIDDEN = 8, 3, 512
SCHEMA = "name string, shape array<int>, values array<double>"


def shapes(dim: int, hidden: int = HIDDEN, layers: int = LAYERS) -> dict[str, tuple[int, ...]]:
    """Names and shapes of a model's weights."""
    wide, out = 4 * hidden, {"in.w": (hidden, dim), "in.b": (hidden,)}
    for n in range(layers):
        out |= {f"{n}.attend.{x}.w": (hidden, hidden) for x in "qkvo"} | {f"{n}.attend.{x}.b": (hidden,) for x in "qkvo"}
        out |= {f"{n}.norm{i}.{x}": (hidden,) for i in (1, 2) for x in ("w", "b")}
        out |= {f"{n}.up.w": (wide, hidden), f"{n}.up.b": (wide,), f"{n}.down.w": (hidden, wide), f"{n}.down.b": (hidden,)}
    return out | {"out.w": (dim, hidden), "out.b": (dim,)}


def fresh(spark: SparkSession, dim: int, hidden: int = HIDDEN, layers: int = LAYERS, seed: int = 7) -> DataFrame:
    """The weights of an untrained model: matrices uniform within the square root of 6 over both widths, gains one, the rest zero.

    Entries are a hash of seed, name and place, so every run and every number of partitions gives the same.
    """
    rows = spark.createDataFrame([(n, list(s), math.sqrt(6 / sum(s)) if len(s) == 2 else 0.0, float(".norm" in n and n.endswith(".w"))) for n, s in shapes(dim, hidden, layers).items()], "name string, shape array<int>, reach double, rest double")
    count = F.aggregate("shape", F.lit(1), lambda a, x: a * x)
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), "name", i), F.lit(1 << 32)).cast("double") / float(1 << 32)
    return rows.select("name", "shape", F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("rest") + F.col("reach") * (2 * unit(i) - 1)).alias("values"))


def load(weights: DataFrame) -> dict[str, np.ndarray]:
    """The weights by name; raises where they are more than MOST values or do not fit their shapes."""
    many = weights.agg(F.sum(F.size("values"))).first()[0] or 0
    if many > MOST:
        raise ValueError(f"{many} values are more than a predictor may have ({MOST})")
    found = {r["name"]: np.array(r["values"], dtype=np.float64).reshape(r["shape"]) for r in weights.select("name", "shape", "values").toLocalIterator()}
    if "in.w" not in found:
        raise ValueError("a predictor has weights named in.w")
    hidden, dim = found["in.w"].shape
    layers = len([n for n in found if n.endswith(".up.w")])
    if {n: w.shape for n, w in found.items()} != shapes(dim, hidden, layers):
        raise ValueError("names or shapes of the weights do not make a predictor")
    return found


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, within 1.5e-7 (Abramowitz and Stegun 7.1.26; fixed values)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.sign(x) * (1 - tail)


def forward(x: np.ndarray, w: dict[str, np.ndarray], heads: int = HEADS) -> np.ndarray:
    """Unit vectors (rows, length, dim) of vectors (rows, length, dim)."""
    line = lambda v, name: v @ w[f"{name}.w"].T + w[f"{name}.b"]

    def norm(v: np.ndarray, name: str) -> np.ndarray:
        v = v - v.mean(-1, keepdims=True)
        return v / np.sqrt((v * v).mean(-1, keepdims=True) + 1e-5) * w[f"{name}.w"] + w[f"{name}.b"]

    def attend(v: np.ndarray, name: str) -> np.ndarray:
        rows, length, hidden = v.shape
        if length == 1:  # a sequence of one attends to itself alone
            return line(line(v, f"{name}.v"), f"{name}.o")
        q, k, v = (line(v, f"{name}.{part}").reshape(rows, length, heads, -1).swapaxes(1, 2) for part in "qkv")
        scores = q @ k.swapaxes(2, 3) / math.sqrt(hidden / heads)
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        mixed = (scores / scores.sum(-1, keepdims=True)) @ v
        return line(mixed.swapaxes(1, 2).reshape(rows, length, hidden), f"{name}.o")

    v = line(x, "in")
    for n in range(len([name for name in w if name.endswith(".up.w")])):
        v = v + attend(norm(v, f"{n}.norm1"), f"{n}.attend")
        up = line(norm(v, f"{n}.norm2"), f"{n}.up")
        v = v + line(0.5 * up * (1 + _erf(up / math.sqrt(2))), f"{n}.down")
    out = line(v, "out")
    return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-12)


def predictor(weights: DataFrame, heads: int = HEADS, rows: int = 1024):
    """A column function array<number> -> array<double>, the predicted unit vector; rows bounds a step's matrices."""
    model = load(weights)
    hidden, dim = model["in.w"].shape
    if hidden % heads:
        raise ValueError(f"{heads} heads do not divide a width of {hidden}")
    sent = weights.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), None, dtype=object)
            for at in range(0, len(batch), rows):
                part = [(at + i, np.asarray(v, dtype=np.float64)) for i, v in enumerate(batch.iloc[at : at + rows]) if v is not None and len(v) == dim]
                part = [(i, v) for i, v in part if np.isfinite(v).all()]
                if part:
                    found = forward(np.stack([v for _, v in part])[:, None, :], sent.value, heads)[:, 0]
                    for (i, _), v in zip(part, found, strict=True):
                        out[i] = v
            yield pd.Series(out, dtype=object)

    return lambda vector: run(vector.cast("array<double>"))
