"""The pipeline against a brute-force version of its stages, and the registered queries' columns."""

import hashlib
import os
import re

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_pipeline_as_brute_force(spark):
    import pandas as pd
    import public_tokenizers as P
    from test_text_operators import brute_near

    from lumenfold.llm.bpe import loaded

    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    left = [(i, t) for i, t in zip(docs.doc_id, docs.text) if t is not None and any(map(str.isalpha, t))]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    first = {}
    for i, t in left:
        for line in t.split("\n"):
            first.setdefault(key(line), i)
    left = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i)) for i, t in left]
    near = brute_near(left)
    left = [(i, t) for i, t in left if near[i][1] == i or not near[i][0]]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    left = [(i, t) for i, t in left if not any(x in norm(t) for x in items)]
    enc = loaded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    wanted = {i: (hashlib.sha256(" ".join(map(str, enc.encode(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left}
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == wanted


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_queries_are_registered():
    from lumenfold.llm import queries

    names = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_near_copies_of_the_pipeline_start_at_0_8(spark):
    words = [f"w{i}" for i in range(100)]
    # one changed word amid 96 shingles changes five of them; two far apart, ten: 86 of 106 are shared
    near = [w if i not in (30, 60) else "other" for i, w in enumerate(words)]
    far = [w if i not in (20, 40, 60, 80) else "third" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 3]
