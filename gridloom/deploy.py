"""Ships this package to the executors of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker of the application.

    The driver zips the sources once and Spark's own file server hands the
    archive to each executor, so no shared or pre-installed folder is needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "gridloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._gridloom_shipped = True
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        # whole texts travel to Python in batches; smaller ones bound what workers hold
        spark.conf.set(_BATCH, "8m")
