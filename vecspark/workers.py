"""The package on Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to this application's workers, once, unless ``PYTHONPATH`` has its folder.

    Functions that run in workers refer to modules of the package, wherever the
    driver was started.
    """
    package, context = Path(__file__).resolve().parent, spark.sparkContext
    there = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.applicationId in _sent or str(package.parent) in there:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="vecspark-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)
