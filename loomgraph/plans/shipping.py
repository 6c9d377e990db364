"""Making this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PACKAGE = "loomgraph"


def ship(spark: SparkSession) -> None:
    """Workers of a local session find the package by its path; a cluster gets it as a zip, once per application."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    if context.master.startswith("local"):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    else:
        name = os.path.join(tempfile.mkdtemp(), f"{PACKAGE}.zip")  # read by the driver only, which serves it
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(os.path.join(ROOT, PACKAGE)):
                for f in sorted(files):
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, ROOT))
        context.addPyFile(name)
    context._loomgraph_shipped = True
