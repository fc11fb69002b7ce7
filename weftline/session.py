"""Session defaults; anything the cluster sets stays as it is."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("weftline").config(map=DEFAULTS | (conf or {}))
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession, path: str) -> None:
    """Puts this package as a zip file at ``path`` (on storage that the driver can write) and gives it to the
    Python workers, for clusters where it isn't installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
