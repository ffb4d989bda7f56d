"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import lectern

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, once an application; Spark's file server carries it."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(lectern.__file__).parent
    made = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "lectern.zip"
    with zipfile.ZipFile(made, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(made))
    _sent.add(context.applicationId)
