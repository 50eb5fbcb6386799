"""Ship this package to the executors, as spark-submit's --py-files would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once per SparkContext: Spark itself copies the archive to every executor, those started later included."""
    context = spark.sparkContext
    if getattr(context, "_linkspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="linkspark-")) / "linkspark_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._linkspark_shipped = True
