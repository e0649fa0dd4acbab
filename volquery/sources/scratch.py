"""The folder that executors share, and tables in it that live as long as the application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder of the context.  A cluster must name one, as its
    machines share no other; a local session falls back to its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a folder its executors share in spark.checkpoint.dir")
        named = f"{tempfile.gettempdir()}/checkpoints/volquery"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return root
