"""Make the package importable on executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "tree", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="grainmill-"), package.name)), "zip", copy.parent)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
