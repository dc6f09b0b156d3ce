"""Seams for models: encoders, classifiers, compressors and judges that a user brings, as Pandas functions.

Each takes a plain Python callable that is loaded once in a process. The defaults beside them need no model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def retried(call: Callable, tries: int = 3, base: float = 2.0, sleep=time.sleep) -> Callable:
    """call, tried again after 1, 2, 4 ... seconds; the last error is raised."""

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception:
                if n + 1 == tries:
                    raise
                sleep(base**n)

    return run


def encoder(make: Callable[[], Callable[[list[str]], list]]):
    """A column function text -> array<float>; make() gives a function of a batch of texts."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            found = model([t or "" for t in texts]) if len(texts) else []
            yield pd.Series([[float(x) for x in v] for v in found], dtype=object)

    return encode


def classifier(make: Callable[[], Callable[[str], dict[str, float]]], default: str = "BACKGROUND"):
    """A column function text -> the best label (the first of equals); `default` if the model fails."""

    @F.pandas_udf("string")
    def top(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = make()
        except ImportError:
            model = None

        def label(text: str) -> str:
            try:
                scores = model(text)
                return max(scores, key=scores.get)
            except Exception:
                return default

        for texts in batches:
            yield texts.map(lambda t: default if model is None or t is None else label(t))

    return top


def prompt(text: str, budget: float, anchors: list[str]) -> str:
    """What a language model is asked."""
    keep = f" Keep these verbatim: {', '.join(anchors)}." if anchors else ""
    return f"Shorten the segment to about {round(100 * budget)} percent of its words.{keep}\nSegment:\n{text}"


def compressor(make: Callable[[], Callable[[str], str]], seconds: float = 30.0):
    """A column function (text, budget, anchors) -> struct<text, timed_out, failed>: the model's answer, or the text itself
    if it is late or fails. Where `failed` says so the caller takes an extractive compressor (`compress.with_fallback`).

    A late call can't be stopped; its pool is left to itself and later rows get a new one, so that they don't wait for it."""

    @F.pandas_udf("text string, timed_out boolean, failed boolean")
    def compress(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model, pool = make(), ThreadPoolExecutor(2)
        try:
            for texts, budgets, anchors in batches:
                out = []
                for t, b, a in zip(texts, budgets, anchors, strict=True):
                    try:
                        out.append((pool.submit(model, prompt(t or "", b, list(a) if a is not None else [])).result(seconds), False, False))
                    except Late:
                        out.append((t, True, False))
                        pool.shutdown(wait=False, cancel_futures=True)
                        pool = ThreadPoolExecutor(2)
                    except Exception:
                        out.append((t, False, True))
                yield pd.DataFrame(out, columns=["text", "timed_out", "failed"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return compress


def substring_judge(context: Column, expected: Column) -> Column:
    """1 if the context holds the expected answer (case aside), else 0."""
    return F.lower(context).contains(F.lower(expected)).cast("double")
