"""Making this package importable in Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the workers' Python path. Where executors
    have no such folder, the package is shipped with ``--py-files`` instead."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    return spark
