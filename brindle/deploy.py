"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_brindle_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder_ = tempfile.mkdtemp(prefix="brindle-ship-")
    atexit.register(shutil.rmtree, folder_, ignore_errors=True)  # the driver serves the file till then
    path = os.path.join(folder_, "brindle.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._brindle_shipped = True
