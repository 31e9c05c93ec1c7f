"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, the context's checkpoint folder, or in local mode one of our own. On a cluster without either it is an error, as no folder of one machine will do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        root = jsc.getCheckpointDir().get()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{work_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path through Hadoop's file system, whatever store it is in; a session that has ended leaves it."""
    with suppress(Exception):  # at the end of the program the session may be gone, or its JVM
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
