"""What depends on order: running totals without a group in one task, folds with bounded state, and tables written in between."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet to the shared folder (spark.checkpoint.dir, else the context's) and read back: no lineage, true sizes, safe from lost executors.

    A local session without such a folder gets one of its own; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    path = f"{at.rstrip('/')}/lumenfold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_same(one: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """one with the columns of other of equal names (nulls equal to nulls); rows without a partner go."""
    renamed = other.select(*[F.col(n).alias(f"_same_{n}") for n in names], *[c for c in other.columns if c not in names])
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_same_{n}"))
    return one.join(renamed, on).drop(*[f"_same_{n}" for n in names])


def running_totals(rows: DataFrame, by: list[str], order: list[Column | str], value: Column | str = 1, parts: int | None = None) -> DataFrame:
    """rows with `before`, the sum of value over the rows of their group that come earlier in order, and `total`, that of the group.

    Rows are dealt by ranges of group and order, so a large group lies in many tasks; sums within a range are windows over
    that range, the sums of whole ranges (one row a group and range at most) are added up and joined back. Rows that tie in `order` come in any order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value
    placed = stage(rows.withColumn("_value", value).repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    group = Window.partitionBy(*by)
    ranges = sums.select(*by, "_range", (F.sum("_sum").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")).alias("_past"), F.sum("_sum").over(group).alias("total"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return join_same(summed, ranges, [*by, "_range"]).select(*rows.columns, (F.col("_past") + F.col("_inside")).alias("before"), "total")


def _values(column: pa.Array) -> list:
    """What to_pylist gives, for plain columns many times as fast."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type) or (pa.types.is_integer(column.type) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def keyed_fold(rows: DataFrame, keys: list[str], order: list[Column | str], start: Callable[[], Callable[[dict], list[tuple]]], schema: str, parts: int | None = None) -> DataFrame:
    """What a fold gives for the rows of each key, in order.

    start() makes the function of one key, which takes a row and gives rows of `schema`; what it remembers is
    all that is held: rows come sorted, batch by batch, and are never gathered. With parts the first key is the number of a task.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*map(_values, batch.columns), strict=True):
                row = dict(zip(batch.schema.names, values, strict=True))
                own = tuple(row[k] for k in keys)
                if step is None or own != key:
                    key, step = own, start()
                out += step(row)
            columns = list(zip(*out, strict=True)) or [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    dealt = rows.repartitionById(parts, keys[0]) if parts else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def kinds_of(rows: DataFrame, *names: str) -> str:
    """The columns with their types, as a schema begins."""
    known = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ", ".join(f"{n} {known[n]}" for n in names)
