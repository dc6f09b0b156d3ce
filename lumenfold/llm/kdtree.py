"""Exact top-k by inner product: KD-trees per shard, searched best first.

Rows are dealt by hash over shards of about `shard_rows`, queries over blocks of
about `query_block`; every pair of a shard and a block is one bounded task, so a
stated query set meets all rows in blocks. A shard's tree splits at the median of its
widest side and keeps tight boxes; nodes are visited in order of the largest inner
product that their box allows, and a search ends when that falls below the k-th
score so far. A bound on the k-th score is propagated to all shards beforehand: the
k-th best among `seed_rows` rows of the smallest hash, which are candidates themselves.

Components are made integers first: floor(scale * x), as double; sums are exact.

Defined results: vectors that are null, empty or hold null, NaN or infinite components
take no part. Vectors meet only those of their own length. A candidate with the query's
own id is not its partner; equal scores go to smaller ids; repeated rows of a candidate
count as they are, repeated query ids as one (the least vector). Null ids take no part. Components so large that
a score may pass 64 bits raise ValueError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """_id and _v (array of long) of the rows that take part."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("_id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("_v"))


class Tree:
    """A KD-tree over integer rows; nodes by number, boxes as matrices."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        lows, highs, todo = [], [], [(0, len(points), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            node = len(self.span)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            part = points[self.order[start:end]]
            low, high = part.min(0), part.max(0)
            self.span.append((start, end))
            self.children.append(None)
            lows.append(low)
            highs.append(high)
            wide = int((high - low).argmax())
            if end - start > LEAF and high[wide] > low[wide]:
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(part[:, wide], half)]
                todo += [(start + half, end, node, 1), (start, start + half, node, 0)]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product with a point of its box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and scores and ids of its best k points of at least its floor."""
    tree = Tree(points)
    bounds = tree.bounds(queries)
    points, ids = points[tree.order], ids[tree.order]
    for n, (query, own, floor) in enumerate(zip(queries, query_ids, floors, strict=True)):
        bound = bounds[n].tolist()
        heap, kth = [(-bound[0], 0)], floor
        top, top_ids = np.empty(0, points.dtype), np.empty(0, np.int64)
        while heap:
            most, node = heapq.heappop(heap)
            if -most < kth:
                break
            if pair := tree.children[node]:
                for child in pair:
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            start, end = tree.span[node]
            scores = points[start:end] @ query
            good = (scores >= kth) & (ids[start:end] != own)
            if good.any():
                top, top_ids = best(np.concatenate([top, scores[good]]), np.concatenate([top_ids, ids[start:end][good]]), k)
                if len(top) == k:
                    kth = max(kth, top[-1])
        yield n, top, top_ids


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """As double where every product sum stays below 2**53, else as long."""
    most = max([1, *(max(int(p.max()), -int(p.min())) for p in parts if p.size)])
    wide = max(p.shape[1] for p in parts)
    if most * most * wide >= 1 << 63:
        raise ValueError(f"components of up to {most} make scores beyond 64 bits")
    return [p.astype(np.float64 if most * most * wide < 1 << 53 else np.int64) for p in parts]


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = 16_384, query_block: int = 8_192, seed_rows: int = 1_024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best partners of every query row."""
    rows = quantized(vectors, id_col, vector_col, scale)
    queries = quantized(vectors.where(is_query), id_col, vector_col, scale).groupBy("_id").agg(F.min("_v").alias("_v"))
    n, asked = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // query_block))
    mixed = F.xxhash64("_id", "_v")
    seeds = {}
    for r in rows.orderBy(mixed, "_id").limit(seed_rows).collect():
        seeds.setdefault(len(r["_v"]), []).append((r["_id"], r["_v"]))
    by_size = {size: (np.array([i for i, _ in got], np.int64), np.array([v for _, v in got], np.int64)) for size, got in seeds.items()}
    spread = lambda df, role, own, many, other, count: df.select("_id", "_v", F.lit(role).alias("_query"), F.size("_v").alias("_size"), F.pmod(mixed, F.lit(many)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(other))
    both = spread(rows, False, "_shard", shards, "_block", blocks).unionByName(spread(queries, True, "_block", blocks, "_shard", shards))

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("_query").to_numpy(zero_copy_only=False).astype(bool)
        ids, all_rows = group.column("_id").to_numpy(), _matrix(group.column("_v"), len(group))
        seed_ids, seed = by_size.get(all_rows.shape[1], (np.empty(0, np.int64), np.empty((0, all_rows.shape[1]), np.int64)))
        points, wanted, seed = _exact(all_rows[~asks], all_rows[asks], seed)
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(points) and len(wanted):
            floors = np.full(len(wanted), -np.inf)
            if len(seed) > k:
                known = wanted @ seed.T
                known = np.where(ids[asks][:, None] == seed_ids, known.min() - 1, known)
                floors = np.partition(known, len(seed) - k, axis=1)[:, len(seed) - k]
                floors = np.where((ids[asks][:, None] != seed_ids).sum(1) >= k, floors, -np.inf)
            for i, scores, found in search(points, ids[~asks], wanted, ids[asks], floors, k):
                out["query_id"] += [int(ids[asks][i])] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [int(s) for s in scores]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    parts = both.groupBy("_shard", "_block", "_size").applyInArrow(run, "query_id long, vec_id long, score long")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
