"""Session settings shared by tests, bench and applications."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_stoplake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="stoplake-src-"), "stoplake_src.zip")
    with open(path, "wb") as out:
        out.write(held.getvalue())
    sc.addPyFile(path)  # Spark hands it to every executor
    sc._stoplake_shipped = True
