"""Session helpers shared by all parts of the package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the folder the driver has it in (clusters may ship it by --py-files too)."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark
