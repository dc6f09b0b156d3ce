"""Nearest neighbours and filters over vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.fidelity import dot

#: Queries and vectors that are multiplied at once.
BLOCK, CHUNK = 512, 8_192
#: Queries and vectors are dealt into so many parts each, into more only where a part would hold more values: copies grow with the rows.
SIDE, MOST_VALUES = 12, 8_388_608


def parts(rows: int, width: int) -> int:
    """Into how many parts rows of a width are dealt."""
    return max(1, min(SIDE, -(-rows // BLOCK)), -(-rows * width // MOST_VALUES))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def best_of(rows: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k highest scores (to nine places) of their row, of equals the earlier places."""
    order = np.lexsort((places, -np.round(scores, 9), rows))
    begins = np.searchsorted(rows[order], rows[order], "left")
    return order[np.arange(len(order)) - begins < k]


def _best(queries: np.ndarray, vectors: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, score) of the k highest of each query, block by block; own has the rows and places of pairs that take no part."""
    for top in range(0, len(queries), BLOCK):
        block = queries[top : top + BLOCK]
        least, kept = np.full(len(block), -np.inf), []
        near = (own[0] >= top) & (own[0] < top + BLOCK)
        own_rows, own_places = own[0][near] - top, own[1][near]
        for at in range(0, len(vectors), CHUNK):
            scores = block @ vectors[at : at + CHUNK].T
            scores[np.isnan(scores)] = -np.inf
            inside = (own_places >= at) & (own_places < at + CHUNK)
            scores[own_rows[inside], own_places[inside] - at] = -np.inf
            if scores.shape[1] >= k:
                least = np.maximum(least, scores.max(1) if k == 1 else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
            # what may be among the k by rounded scores: the margin is twice a unit of the ninth place
            rows, places = np.nonzero((scores >= (least - 2e-9)[:, None]) & (scores > -np.inf))
            found = np.round(scores[rows, places], 12)
            some = best_of(rows, places, found, k)
            kept.append((rows[some], places[some] + at, found[some]))
        rows, places, found = (np.concatenate(x) for x in zip(*kept, strict=True))
        some = best_of(rows, places, found, k)
        yield rows[some] + top, places[some], found[some]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, query_id: str = "query_id", query_vector: str = "vector", id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """(query_id, rank, id, score): exact, by inner product of unit vectors; equal scores (to nine places) go to smaller ids.

    Both are dealt into at most SIDE parts (more only where a part would pass MOST_VALUES), so the copies that are shuffled grow with
    the rows; a task multiplies two parts piece by piece and keeps k a query, so no row stands for a pair; what is kept of
    all parts is ranked again. Null, empty and other-sized vectors find nothing.
    """
    whole = lambda df, v: F.col(v) if dict(df.dtypes)[v] == "array<float>" else F.col(v).cast("array<double>")
    named = lambda df, i, v, kind: df.where(F.col(v).isNotNull() & F.col(i).isNotNull() & (F.size(v) > 0)).select(F.col(i).alias(kind), whole(df, v).alias("v"), F.size(v).alias("size"))
    asked, rows = named(queries, query_id, query_vector, "query_id"), named(vectors, id_col, vector_col, "id")
    # only vectors as wide as a query take part
    count, width = asked.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(1))).first()
    blocks, chunks = parts(count, width), parts(vectors.count(), width)

    def dealt(df: DataFrame, own: str, many: int, other: str, count: int) -> DataFrame:
        mixed = F.pmod(F.xxhash64(df.columns[0]), F.lit(many)).cast("int")
        return df.select("*", mixed.alias(own), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(other))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": left.schema.field("query_id").type, "id": right.schema.field("id").type}
        tables = [pa.table({"query_id": pa.array([], kinds["query_id"]), "id": pa.array([], kinds["id"]), "score": pa.array([], pa.float64())})]
        if len(left) and len(right):
            right = right.take(pc.sort_indices(right.column("id")))
            own: list[tuple[int, int]] = []
            if skip_self:
                places: dict = {}
                for n, i in enumerate(right.column("id").to_pylist()):
                    places.setdefault(i, []).append(n)
                own = [(n, at) for n, i in enumerate(left.column("query_id").to_pylist()) for at in places.get(i, ())]
            pairs = np.array(own, dtype=np.int64).reshape(-1, 2)
            for row, at, score in _best(_matrix(left.column("v"), len(left)), _matrix(right.column("v"), len(right)), (pairs[:, 0], pairs[:, 1]), k):
                tables.append(pa.table({"query_id": left.column("query_id").take(pa.array(row)), "id": right.column("id").take(pa.array(at)), "score": pa.array(score)}))
        return pa.concat_tables(tables)

    keys = ["_block", "_chunk", "size"]
    left, right = dealt(asked, "_block", blocks, "_chunk", chunks), dealt(rows, "_chunk", chunks, "_block", blocks)
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest_cached(questions: DataFrame, cached: DataFrame, threshold: float = 0.85, **names) -> DataFrame:
    """The most similar cached entry of each question, if it is over the threshold."""
    return cosine_topk(questions, cached, 1, **names).where(F.col("score") > threshold).drop("rank")


def pair_filter(pairs: DataFrame, left: str, right: str, most: float) -> DataFrame:
    """Pairs whose cosine is `most` at most."""
    return pairs.withColumn("cosine", dot(F.col(left), F.col(right))).where(F.col("cosine") <= most)


def project3d(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: float = 5.0) -> DataFrame:
    """Three principal components of each vector, stretched to [-side, side] by their least and greatest values."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    as_vectors = vectors.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("_x"))
    made = PCA(k=3, inputCol="_x", outputCol="_p").fit(as_vectors).transform(as_vectors).select(id_col, vector_to_array("_p").alias("_p"))
    axes = made.select(id_col, *[F.col("_p")[i].alias(c) for i, c in enumerate("xyz")])
    ends = axes.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), 2 * side * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) - side).otherwise(0.0)
    return axes.crossJoin(F.broadcast(ends)).select(id_col, *[at(c).alias(c) for c in "xyz"])  # ends is one row
