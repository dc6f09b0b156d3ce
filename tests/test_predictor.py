"""The head's forward pass against a slow plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import predictor


def plain(xs, w, heads):
    """The same by loops over numbers."""
    line = lambda v, n: [sum(a * b for a, b in zip(row, v, strict=True)) + c for row, c in zip(w[n + ".w"], w[n + ".b"], strict=True)]

    def norm(v, n):
        mean = sum(v) / len(v)
        var = sum((x - mean) ** 2 for x in v) / len(v)
        return [(x - mean) / math.sqrt(var + 1e-5) * g + b for x, g, b in zip(v, w[n + ".w"], w[n + ".b"], strict=True)]

    vs = [line(x, "in") for x in xs]
    wide = len(vs[0])
    for n in range(sum(k.endswith(".up.w") for k in w)):
        normed = [norm(v, f"{n}.norm1") for v in vs]
        q, k, v = ([line(x, f"{n}.attend.{p}") for x in normed] for p in "qkv")
        for i in range(len(vs)):
            mixed = []
            for h in range(heads):
                part = range(h * wide // heads, (h + 1) * wide // heads)
                scores = [math.exp(sum(q[i][d] * k[j][d] for d in part) / math.sqrt(wide / heads)) for j in range(len(vs))]
                mixed += [sum(s * v[j][d] for j, s in enumerate(scores)) / sum(scores) for d in part]
            vs[i] = [a + b for a, b in zip(vs[i], line(mixed, f"{n}.attend.o"), strict=True)]
        for i in range(len(vs)):
            up = [x / 2 * (1 + math.erf(x / math.sqrt(2))) for x in line(norm(vs[i], f"{n}.norm2"), f"{n}.up")]
            vs[i] = [a + b for a, b in zip(vs[i], line(up, f"{n}.down"), strict=True)]
    out = [line(v, "out") for v in vs]
    return [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in out]


def weights(dim, hidden, layers, seed=3):
    rng = np.random.default_rng(seed)
    return {n: rng.normal(size=s) * 0.3 for n, s in predictor.shapes(dim, hidden, layers).items()}


@pytest.mark.parametrize("length", [1, 4])
def test_as_the_plain_one(length):
    w = weights(6, 8, 2)
    x = np.random.default_rng(length).normal(size=(3, length, 6))
    got = predictor.forward(x, w, heads=2)
    for row, vs in zip(x, got, strict=True):
        assert np.allclose(vs, plain(row.tolist(), {n: v.tolist() for n, v in w.items()}, 2), atol=1e-5)


def test_over_a_table(spark):
    w = weights(4, 8, 1)
    table = spark.createDataFrame([(n, list(v.shape), v.ravel().tolist()) for n, v in w.items()], predictor.SCHEMA)
    rows = [(1, [1.0, 2.0, 0.0, -1.0]), (2, None), (3, []), (4, [1.0, None, 0.0, 0.0]), (5, [1.0, float("nan"), 0.0, 0.0]), (6, [1.0] * 5), (7, [1.0, 2.0, 0.0, -1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: r["p"] for r in df.select("id", predictor.predictor(table, heads=2, rows=2)(F.col("v")).alias("p")).collect()}
    assert np.allclose(got[1], predictor.forward(np.array([[[1, 2, 0, -1.0]]]), w, 2)[0, 0]) and got[7] == got[1]
    assert {i for i, v in got.items() if v is None} == {2, 3, 4, 5, 6}
    assert df.limit(0).select(predictor.predictor(table, heads=2)(F.col("v"))).count() == 0


def test_weights(spark):
    table = predictor.fresh(spark, 4, 8, 2)
    w = predictor.load(table)
    assert set(w) == set(predictor.shapes(4, 8, 2)) and (w["0.norm1.w"] == 1).all() and (w["1.up.b"] == 0).all()
    reach = math.sqrt(6 / 12)
    assert abs(w["in.w"]).max() <= reach and abs(w["in.w"]).max() > reach / 2
    assert all((predictor.load(predictor.fresh(spark, 4, 8, 2).repartition(3))[n] == v).all() for n, v in w.items())
    with pytest.raises(ValueError):
        predictor.load(table.where("name <> '0.up.w'"))
    with pytest.raises(ValueError):
        predictor.predictor(table, heads=3)
