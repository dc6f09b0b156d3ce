"""Sessions: sending this package to the executors, and batches that suit long texts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
#: Rows in an Arrow batch: documents may be long, and a batch lies in the memory of the JVM and of Python at once.
ARROW_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, so that Python workers can import it wherever they run.

    Arrow batches are made small too, unless the session has a setting of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lumenfold-zip-")) / "lumenfold.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))
    _SENT.add(sc.applicationId)
