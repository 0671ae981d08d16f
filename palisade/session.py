"""Session settings and the shared folder used for lineage cuts and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; all can be changed on a live session."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        # rank filters cut every input task's rows before the shuffle, whatever the rank
        "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a local session that names no such folder (tests, a laptop) gets one; on a cluster, where
    executors would not share it, a missing setting is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str, compression: str | None = None):
    """Write to the shared folder and read back: cuts lineage and fixes the rows of every re-read."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
