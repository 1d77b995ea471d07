"""Direction analytics on panel time series, declared as Spark DataFrame plans."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks find it where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_fjordline_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="fjordline-"), "fjordline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("fjordline", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._fjordline_sent = True
