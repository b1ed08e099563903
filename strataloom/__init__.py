"""strataloom: a PySpark-native analytics engine for raster images and other gridded data."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

__version__ = "0.1.0"


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once: they import it wherever the driver was started from."""
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_strataloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="strataloom-")), "strataloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._strataloom_shipped = True
