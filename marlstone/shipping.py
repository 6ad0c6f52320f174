"""Sends this package to the executors, so that Python code in tasks can import it wherever they run."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.join("marlstone", os.path.relpath(os.path.join(d, n), root)))
    sc.addPyFile(path)
    sc._marlstone_shipped = True


def ship_by_value(module: str) -> None:
    """From now on this module's classes and functions go to Python processes as they are, and not as names to import: those that Spark starts on the driver for
    streams don't see the files that executors get."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
