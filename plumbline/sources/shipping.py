"""Sends this package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Registers the package as a Python file of the session, once per application; Spark serves it to the executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()  # Spark serves the archive from here to executors that start later
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, Path(folder, "staged", package.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/staged"))
    _shipped.add(context.applicationId)
