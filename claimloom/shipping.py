"""Makes the package importable where tasks run, whatever folder the driver was started in."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="claimloom-ship-"), "claimloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("claimloom", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
