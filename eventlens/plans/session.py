"""Recommended settings, and where scratch data may go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Recommended on a cluster, beside the defaults (AQE with skew handling and
#: partition coalescing, Parquet pushdown, reuse of shuffles).
CLUSTER = {
    # Starting point only: AQE merges small partitions down to the advisory size.
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def scratch_dir(spark: SparkSession) -> str:
    """A new directory in the shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder of this machine if all of Spark runs in one process on it, as in tests; else an error.
    Spark deletes the directory when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        folder = f"{shared.rstrip('/')}/eventlens-{uuid.uuid4().hex}"
    else:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master!r} share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _delete_at_the_end(spark, folder)
    return folder


def _delete_at_the_end(spark: SparkSession, folder: str) -> None:
    context = getattr(spark, "_jvm", None)
    if context is not None:
        path = context.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
