"""Makes this package importable in Python workers of a session that was started without it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package as a zip, once per Spark application, unless PYTHONPATH already leads to it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    on_path = (os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    if context.applicationId in _shipped or str(root) in on_path:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "roadpulse.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "roadpulse").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shipped(query):
    """``query`` with the package shipped before it runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    return run
