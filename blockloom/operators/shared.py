"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Only on a local master (tests, one machine) is a temporary folder made where neither is set. On a cluster that
    would be a folder of one machine, so there the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not folder:
        if current.isEmpty() and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="blockloom-")
    if current.isEmpty():
        context.setCheckpointDir(folder)
    return folder
