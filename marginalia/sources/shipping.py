"""The package sent along with a session, so that Python workers find it wherever they start."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the session's Python files, once; Spark serves it to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return spark
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="marginalia-code-"), "marginalia.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._marginalia_shipped = True
    return spark
