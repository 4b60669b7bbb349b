"""Prepares a session: the package on the executors, Arrow batches of bounded memory."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch where the session has Spark's own default: texts are long, and a batch is held twice.
ARROW_ROWS = 1000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors through Spark, once an application, and bounds Arrow batches."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="blockweave-code-"), "blockweave.zip")  # the driver serves it from here
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("blockweave", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(out)
