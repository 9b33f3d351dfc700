"""Sessions, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
    }
    return SparkSession.builder.appName("graphloom").config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of ``spark``'s executors, once a context."""
    sc = spark.sparkContext
    if sc not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), "graphloom_package.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        sc.addPyFile(path)
        _SHIPPED.add(sc)
    return spark
