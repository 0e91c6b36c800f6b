"""Sessions: settings for local work, and the package for executors that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, adaptive and in UTC."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that kernels can be imported there."""
    context = spark.sparkContext
    if getattr(context, "_terravane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="terravane-")) / "terravane.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    context._terravane_shipped = True
