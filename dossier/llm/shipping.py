"""Hand the package to executors that have no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import dossier

ARCHIVE = "dossier-package.zip"


def ship(spark: SparkSession) -> None:
    """Let the driver serve the package's source to Python workers, once per session."""
    context = spark.sparkContext
    if ARCHIVE in context._python_includes:
        return
    root = os.path.dirname(dossier.__file__)
    archive = os.path.join(tempfile.mkdtemp(prefix="dossier-"), ARCHIVE)
    with zipfile.ZipFile(archive, "w") as pack:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    pack.write(path, os.path.join("dossier", os.path.relpath(path, root)))
    context.addPyFile(archive)
