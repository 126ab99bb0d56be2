"""Making this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers, once for each application.

    Workers that have it on their path already (``--py-files``, an installed wheel)
    are unaffected.
    """
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="logloom-")) / "logloom.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".csv"):
                out.write(path, f"logloom/{path.relative_to(root).as_posix()}")
    context.addPyFile(str(bundle))
    context._logloom_shipped = True
    return spark
