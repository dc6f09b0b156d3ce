"""Embedding whitening by a tiled covariance.

1. Components c become integers, x = floor(scale * c) + offset; their sums and squares of deviations are exact.
2. Every Arrow batch of rows is a row block. Its vectors, centred by the exact sums before anything
   is multiplied, are cut into blocks of TILE columns; these column blocks are shuffled by their row block.
3. A task multiplies each pair of column blocks of a row block, which is a tile of the covariance, adds the products up by tile,
   and passes on one sum a tile; these are added up by tile and entry. Memory holds one row block and the tiles.
4. The tiles, whose number depends on the width of the vectors alone, are assembled and decomposed on the driver.
   Rows are projected on the eigenvectors of the largest eigenvalues, each over its root.
5. The covariance of what comes out is worked out over all rows by the same tiles, as a check.

Defined results: vectors that are null, empty or hold null, NaN or infinite entries are dropped; what is left is
fitted and whitened, rows with a null id or a repeated one each as they are. Vectors of different lengths, or entries
and sums beyond exact integers, raise ValueError. Eigenvectors bear the sign that makes
their largest entry positive; equal eigenvalues may come in any order. A component without variance (constant or
dependent dimensions, a single row) has a null whitened value, explains 0 and is left out of the check.
Other columns take no part, whatever their names; a table without usable rows gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS, TILE = 64.0, 1_000_000, 32, 16

Prepare = Callable[[pa.RecordBatch], np.ndarray]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """_id and _v (array of double) of the rows that are not dropped."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(1)
    widths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {widths.tolist()[:9]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def integers(batch: pa.RecordBatch, scale: float = SCALE, offset: int = OFFSET) -> np.ndarray:
    """x of each entry, as long."""
    scaled = np.floor(scale * _matrix(batch))
    if len(batch) and np.abs(scaled).max() >= 1 << 52:
        raise ValueError("a component is too large for exact integers")
    return scaled.astype(np.int64) + offset


def _sums(rows: DataFrame, prepare: Prepare, exact: bool) -> tuple[int, list]:
    """The number of rows, and the sum of each column of what prepare makes of them: integers, or doubles."""
    kind = pa.decimal128(38, 0) if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m = prepare(batch)
                at, n = np.arange(m.shape[1], dtype=np.int32), np.full(m.shape[1], len(m))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.array(m.sum(0).tolist(), kind)], names=["at", "n", "total"])

    parts = rows.mapInArrow(run, f"at int, n long, total {'decimal(38,0)' if exact else 'double'}")
    got = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()
    if len({r["n"] for r in got}) > 1:
        raise ValueError("vectors of different lengths")
    return (got[0]["n"], [int(r["total"]) if exact else r["total"] for r in got]) if got else (0, [])


def column_blocks(rows: DataFrame, prepare: Prepare, tile: int = TILE) -> DataFrame:
    """(row_block, column_block, height, entries) of what prepare makes of the rows: each batch is a row block, entries are its doubles row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            m = prepare(batch)
            cuts = [np.ascontiguousarray(m[:, c : c + tile]).tobytes() for c in range(0, m.shape[1], tile)] if len(batch) else []
            yield pa.RecordBatch.from_arrays([pa.array([task + number] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array([len(m)] * len(cuts), pa.int32()), pa.array(cuts, pa.binary())], names=["row_block", "column_block", "height", "entries"])

    return rows.mapInArrow(run, "row_block long, column_block int, height int, entries binary")


def tile_sums(blocks: DataFrame) -> DataFrame:
    """(upper, lower, at, total): the entries of the sum over row blocks of each tile, a pair of column blocks with upper <= lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        held: list[np.ndarray] = []  # the column blocks of one row block
        current = None
        for batch in batches:
            for row_block, column_block, height, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_block != current:
                    held, current = [], row_block
                block = np.frombuffer(entries).reshape(height, -1)
                held.append(block)
                for upper, other in enumerate(held):
                    product = other.T @ block
                    tiles[upper, column_block] = tiles[upper, column_block] + product if (upper, column_block) in tiles else product
        for (upper, lower), tile in tiles.items():
            yield pa.RecordBatch.from_arrays([pa.array([upper], pa.int32()), pa.array([lower], pa.int32()), pa.array([tile.ravel().tolist()], pa.list_(pa.float64()))], names=["upper", "lower", "tile"])

    dealt = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    return dealt.mapInArrow(run, "upper int, lower int, tile array<double>").select("upper", "lower", F.posexplode("tile").alias("at", "value")).groupBy("upper", "lower", "at").agg(F.sum("value").alias("total"))


def covariance(rows: DataFrame, prepare: Prepare, n: int, width: int, tile: int = TILE) -> np.ndarray:
    """The covariance (divisor n) of what prepare makes of the rows, which is centred."""
    out = np.zeros((width, width))
    for r in tile_sums(column_blocks(rows, prepare, tile)).collect():
        down, across = divmod(r["at"], min(tile, width - r["lower"] * tile))
        i, j = r["upper"] * tile + down, r["lower"] * tile + across
        out[i, j] = out[j, i] = r["total"] / n
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n rows, exact sums, eigenvalues (falling), unit eigenvectors as columns, shares of the trace, and the measured error (None before the check)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    shares: np.ndarray
    scale: float = SCALE
    offset: int = OFFSET
    identity_error: float | None = None

    def deviations(self, batch: pa.RecordBatch) -> np.ndarray:
        """n * x - S of each entry, as long."""
        x, sums = integers(batch, self.scale, self.offset), np.array(self.sums, object)
        if x.shape[1] != len(sums):
            raise ValueError("vectors of different lengths")
        if len(x) and max(self.n * int(np.abs(x).max()), int(np.abs(sums).max())) >= 1 << 62:
            raise ValueError("sums are too large for exact integers")
        return self.n * x - sums.astype(np.int64)

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.deviations(batch) / self.n

    def whitened(self, batch: pa.RecordBatch) -> np.ndarray:
        """The projections over the roots of their eigenvalues; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(batch) @ self.vectors / np.sqrt(self.values), np.nan)


def _deviation(whole: np.ndarray) -> np.ndarray:
    if whole.size and (np.square(whole.astype(np.float64)).sum(1) >= 9.2e18).any():
        raise ValueError("a deviation is too large for exact integers")
    return np.square(whole).sum(1)


def fit(rows: DataFrame, components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET, tile: int = TILE) -> Whitening | None:
    """The whitening of usable rows, with its check; None if there are none."""
    n, sums = _sums(rows, lambda batch: integers(batch, scale, offset), exact=True)
    if not n:
        return None
    width = len(sums)
    plain = Whitening(n, tuple(sums), np.ones(width), np.eye(width), np.zeros(width), scale, offset)
    v = covariance(rows, plain.centred, n, width, tile)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    trace = np.trace(v)
    real = values > values[:1].max(initial=0) * width * 8 * np.finfo(float).eps
    values = np.where(real, values, 0.0)
    found = Whitening(n, tuple(sums), values, vectors, values / trace if trace > 0 else np.zeros(len(values)), scale, offset)
    used = int(real.sum())
    if not used:
        return Whitening(**(vars(found) | {"identity_error": 0.0}))
    own = lambda batch: found.whitened(batch)[:, :used]
    means = np.array(_sums(rows, own, exact=False)[1]) / n
    error = np.abs(covariance(rows, lambda batch: own(batch) - means, n, used, tile) - np.eye(used)).max()
    return Whitening(**(vars(found) | {"identity_error": float(error)}))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET, tile: int = TILE) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained and identity_error of every usable row and component."""
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows, components, scale, offset, tile)
    if model is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(1).alias("component"), *[F.lit(0).cast(k).alias(c) for c, k in (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                out = model.whitened(batch)
                flat = pa.array(out.ravel(), from_pandas=True)  # NaN to null
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(model.deviations(batch))), pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], flat)], names=[id_col, "deviation", "all"])

    long = rows.mapInArrow(run, f"`{id_col}` long, deviation long, all array<double>").select(id_col, "deviation", F.posexplode("all").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(x)) for x in model.shares])
    return long.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
