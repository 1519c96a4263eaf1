"""Make the package importable on the executors of a running session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to all executors (what ``--py-files`` does at submit time), once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="codesieve-ship-")
    archive = shutil.make_archive(os.path.join(folder, "codesieve"), "zip",
                                  os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
