"""A new folder in ``spark.checkpoint.dir``, which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A folder of this application that is removed when it ends. Without the setting: a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(f"{base}/{context.applicationId}")
    own.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(own)
    return f"{base}/{context.applicationId}/{tag}-{uuid.uuid4().hex}"
