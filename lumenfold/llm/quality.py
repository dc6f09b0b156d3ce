"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network with calibrated probabilities.

Every word (a hashed bucket of its normal form) has a fixed sparse random index
vector; its word vector is the mean index vector of its neighbours over all
documents. These sums are of a fixed size (BUCKETS x DIMS floats, 2 MB) however
large the corpus is: each task adds up its own, two levels of grouped sums add
these, and only the final table reaches the driver. A document's features pool
the word vectors and index vectors of all its tokens.

The network (tanh layer, then a logistic unit) is fitted with numpy on a bounded
sample of at most about `sample_rows` labelled rows (400 bytes a row), and a
temperature is fitted on a fifth of them that training leaves out.

Defined results: null and empty texts get features of zeros and so a score of their own;
with no labelled rows, or labels of one kind only, every score is the share of label 1
(0.5 without any). Null labels are left out. Repeated rows get the same score. Other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Word vectors travel in so many blocks of buckets; partial sums meet in SALTS groups for each block first.
BLOCKS, SALTS = 64, 64
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Characters of a text that are cut into tokens at a time, and words remembered by a process.
PIECE, WORDS = 1 << 20, 500_000
WIDTH = 3 * DIMS + 3


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its nonzero entries and their signs."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


class _Buckets(dict):
    def __missing__(self, token: str) -> int:
        if token.isalpha():
            form = "<upper>" if len(token) > 1 and token.isupper() else token.lower()
        elif token[0].isdigit():
            form = f"<digits {min(len(token), 6)}>"
        else:
            form = f"<signs {token[:3]}>"
        got = zlib.crc32(form.encode()) % BUCKETS
        if len(self) < WORDS:
            self[token] = got
        return got


_STATE: dict[str, object] = {}


def _state() -> tuple[_Buckets, np.ndarray, np.ndarray, np.ndarray]:
    if not _STATE:
        places, signs = _index_vectors()
        dense = np.zeros((BUCKETS, DIMS), np.float32)
        for k in range(NONZERO):
            np.add.at(dense, (np.arange(BUCKETS), places[:, k]), signs[:, k])
        _STATE["all"] = _Buckets(), places, signs, dense
    return _STATE["all"]  # type: ignore[return-value]


def token_buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all tokens, a piece of the text at a time; pieces end at a blank where there is one."""
    words = _state()[0]
    start = 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        if end < len(text) and (cut := text.rfind(" ", start, end)) > start:
            end = cut
        found = TOKEN.findall(text, start, end)
        yield np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        start = end


def add_contexts(sums: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
    """Add to each token's bucket the index vectors of its neighbours."""
    _, places, signs, _ = _state()
    counts += np.bincount(ids, minlength=BUCKETS)
    for gap in range(1, WINDOW + 1):
        for one, other in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
            for k in range(NONZERO):
                sums += np.bincount(one * DIMS + places[other, k], weights=signs[other, k], minlength=BUCKETS * DIMS)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all texts, BUCKETS x DIMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, waiting, held = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for ids in token_buckets(text or ""):
                    waiting += [ids]
                    held += len(ids)
                if held > 200_000:
                    add_contexts(sums, counts, np.concatenate(waiting))
                    waiting, held = [], 0
        if held:
            add_contexts(sums, counts, np.concatenate(waiting))
        if counts.any():
            from pyspark import TaskContext

            task = TaskContext.get().partitionId() % SALTS
            both = np.column_stack([sums.reshape(BUCKETS, DIMS), counts]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in np.split(both, BLOCKS)], pa.binary())], names=["block", "salt", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["sums"])
        return pd.DataFrame({"block": frame["block"][:1], "salt": [0], "sums": [total.astype(np.float32).tobytes()]})

    kind = "block int, salt int, sums binary"
    parts = docs.select(text_col).mapInArrow(run, kind)
    added = parts.groupBy("block", "salt").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind).collect()
    table = np.zeros((BUCKETS, DIMS + 1), np.float32)
    for row in added:
        rows = BUCKETS // BLOCKS
        table[row["block"] * rows : (row["block"] + 1) * rows] = np.frombuffer(row["sums"], np.float32).reshape(rows, DIMS + 1)
    return table[:, :DIMS] / np.maximum(table[:, DIMS:], 1) / np.sqrt(2 * WINDOW * NONZERO)


def document_features(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Means of word vectors, of their squares and of index vectors over all tokens; length, repetition and longest token share."""
    counts, n = np.zeros(BUCKETS), 0
    for ids in token_buckets(text or ""):
        counts += np.bincount(ids, minlength=BUCKETS)
        n += len(ids)
    if not n:
        return np.zeros(WIDTH, np.float32)
    used = np.flatnonzero(counts)
    share = (counts[used] / n).astype(np.float32)
    own, index = vectors[used], _state()[3][used]
    rest = [np.log1p(n) / 10, float((share * share).sum()) * 3, len(used) / n]
    return np.concatenate([share @ own, share @ (own * own), share @ index / 2, rest]).astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for feature rows."""
        if self.w1 is None:
            return np.full(len(x), self.base)
        z = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 24, epochs: int = 120) -> QualityModel:
    """The network of feature rows and labels 0 or 1, by Adam; the temperature comes from every fifth row."""
    base = float(y.mean()) if len(y) else 0.5
    if not 0 < base < 1 or len(y) < 10:
        return QualityModel(vectors, base)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    check, train = order[::5], np.setdiff1d(order, order[::5])
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    z, t = (x - mean) / scale, y.astype(np.float64)
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        rows = rng.permutation(train)
        for part in np.array_split(rows, max(1, len(rows) // 128)):
            h = np.tanh(z[part] @ p["w1"] + p["b1"])
            out = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"][0], -30, 30)))
            d = (out - t[part]) / len(part)
            dh = np.outer(d, p["w2"]) * (1 - h * h)
            grads = {"w1": z[part].T @ dh + 1e-3 * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-3 * p["w2"], "b2": np.array([d.sum()])}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, base, mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    grid = np.geomspace(0.3, 6, 40)

    def loss(temperature: float) -> float:
        model.temperature = float(temperature)
        q = np.clip(model.score(x[check]), 1e-9, 1 - 1e-9)
        return float(-(t[check] * np.log(q) + (1 - t[check]) * np.log(1 - q)).mean())

    model.temperature = float(min(grid, key=loss))
    return model


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000) -> QualityModel:
    """The model of all texts of docs and of a sample of the rows (id, label) of labelled."""
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col)
    rows = labelled.where(labelled[label_col].isin(0, 1) & labelled[id_col].isNotNull()).select(labelled[id_col].alias("_q_id"), labelled[label_col].cast("int").alias("_q_label"))
    n = rows.count()
    if not n:
        return QualityModel(vectors, 0.5)
    draw = F.pmod(F.xxhash64("_q_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.where(draw < min(1.0, sample_rows / n)).distinct()  # an id that is labelled over and over is one row a label
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["_q_id"].astype("int64"), "label": batch["_q_label"], "x": [document_features(t, shared.value).tobytes() for t in batch["text"]]})

    # the sample's bound is sample_rows, so it may be broadcast
    joined = docs.select(docs[id_col].alias("_q_doc"), docs[text_col].alias("text")).join(F.broadcast(sample), F.col("_q_doc") == F.col("_q_id")).select("_q_id", "_q_label", "text")
    got = joined.mapInPandas(run, "id long, label int, x binary").collect()
    if not got:
        return QualityModel(vectors, 0.5)
    got.sort(key=lambda r: (r["id"], r["label"], bytes(r["x"])))
    return fit_network(np.array([np.frombuffer(r["x"], np.float32) for r in got]), np.array([r["label"] for r in got]), vectors)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """docs with the probability of good quality of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = [document_features(t, shared.value.vectors) for t in batch]
            yield pd.Series(shared.value.score(np.array(rows, np.float32).reshape(len(rows), WIDTH)), dtype="float64")

    return docs.withColumn(out_col, run(docs[text_col]))
