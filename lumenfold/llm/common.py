"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D], and ASCII letters.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembering(name: str, forget: Callable[[], None]) -> None:
    """Say that this Python process now remembers things for one operator, which `forget` drops. Spark uses processes again: what others left goes."""
    for other in [x for x in _REMEMBERED if x != name]:
        _REMEMBERED.pop(other)()
    _REMEMBERED[name] = forget


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a folder of its own; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors, and gives Catalyst true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenfold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
