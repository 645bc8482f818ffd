"""The package on the executors, where it need not be installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: marks a context that has the package
_DONE = "_package_shipped"


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a context.

    Whatever runs in a worker calls this first. The archive goes from the driver
    to all executors with the context's own files, also to those that join later.
    """
    context = spark.sparkContext
    if getattr(context, _DONE, False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{here.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(path))
    setattr(context, _DONE, True)
