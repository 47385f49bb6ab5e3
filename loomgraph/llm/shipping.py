"""Sends this package to the executors, so that its Python stages need no installation there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import loomgraph

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package's source to the application's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(loomgraph.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="loomgraph"), "loomgraph_source.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("loomgraph", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
