"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows of a batch for Python workers: texts of some kilobytes make batches of some megabytes.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS, DEFAULT_ROWS = "2000", "10000"


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per application; smaller batches where nothing else is set."""
    context = spark.sparkContext
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quire-src-")) / "quire.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
