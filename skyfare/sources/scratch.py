"""Where a job may write intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in a folder that all executors share.

    That is the folder of ``spark.checkpoint.dir``, else the context's
    checkpoint folder, else one below the warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
