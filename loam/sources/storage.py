"""The folder for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, the application's temporary one,
    which only a local master can use; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/loam-{spark.sparkContext.applicationId}"
    return path.rstrip("/")
