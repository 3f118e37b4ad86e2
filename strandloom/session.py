"""Session settings shared by the bench, the tests and the command line, and the folder of checkpoints."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandloom")
        .config("spark.driver.memory", os.environ.get("STRANDLOOM_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # those that no table refers to any more go
        .getOrCreate()
    )


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """spark with a checkpoint folder: spark.checkpoint.dir. A local session may leave it unset, a cluster may not."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or "/tmp/checkpoints/strandloom")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of checkpoints, which all executors share."""
    return f"{with_checkpoints(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
