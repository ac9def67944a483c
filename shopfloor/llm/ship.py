"""Makes the package importable in the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors (as ``--py-files`` would); a local master's workers are given the path."""
    # Ten thousand long texts in one batch would not fit a worker; a batch ends by its bytes as well.
    spark.conf.set(BATCH_BYTES, str(4 << 20))
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if sc.master == "local" or sc.master.startswith("local["):
        # Workers take the PYTHONPATH and working folder of the driver.
        known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
        if any(p and Path(p).resolve() == root for p in known):
            return
    target = os.path.join(tempfile.mkdtemp(prefix="shopfloor-py-"), "shopfloor")
    sc.addPyFile(shutil.make_archive(target, "zip", root, "shopfloor"))
    _SHIPPED.add(app)
