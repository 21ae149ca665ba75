"""This package for Python workers, which may run where the driver's folders aren't."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to every executor, once a session. Plans whose Python code is this package's call it first."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_shipped", None) == package:
        return
    path = Path(SparkFiles.getRootDirectory(), "shipped", f"{package.name}.zip")
    path.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zipped:
        for file in sorted(package.rglob("*.py")):
            zipped.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._shipped = package
