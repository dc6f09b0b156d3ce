import time

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import seams


def test_encoder_and_classifier(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert {tuple(r[0]) for r in df.select(seams.encoder(lambda: lambda texts: [[len(t), 1] for t in texts])("t")).collect()} == {(2.0, 1.0), (0.0, 1.0)}
    assert [r[0] for r in df.select(seams.classifier(lambda: lambda t: {"FACTUAL": 0.9, "CAUSAL": 0.9})("t")).collect()] == ["FACTUAL", "BACKGROUND"]


def test_late_or_failing_compressors_leave_the_text(spark):
    def model(prompt):
        if "slow" in prompt:
            time.sleep(2)
        if "bad" in prompt:
            raise RuntimeError
        return "short"

    df = spark.createDataFrame([("fine", 0.5), ("slow", 0.5), ("bad", 0.5)], "t string, b double").coalesce(1)
    got = df.select("t", seams.compressor(lambda: model, 0.5)("t", "b", F.array(F.lit("x"))).alias("c")).collect()
    assert {r["t"]: (r["c"]["text"], r["c"]["timed_out"]) for r in got} == {"fine": ("short", False), "slow": ("slow", True), "bad": ("bad", False)}


def test_retries_and_judge(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError
        return x

    assert seams.retried(flaky, sleep=lambda s: None)(5) == 5 and len(calls) == 3
    with pytest.raises(ValueError):
        seams.retried(lambda: int("x"), sleep=lambda s: None)()
    assert spark.range(1).select(seams.substring_judge(F.lit("The Answer"), F.lit("answer"))).first()[0] == 1.0
