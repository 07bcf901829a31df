"""Session helpers: a local session for tests/bench and the shared checkpoint dir.

On a cluster the caller supplies the session; nothing here changes settings a
cluster already has. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` and only
sets a scratch folder when it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


JIT_OPTIONS = "-XX:-DontCompileHugeMethods"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "transitlab") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRANSITLAB_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The classifier compiles to large generated methods; HotSpot does not
        # JIT methods over 8 KB of bytecode unless told to. Set the same option
        # for executors on a cluster (spark.executor.extraJavaOptions).
        .config("spark.driver.extraJavaOptions", JIT_OPTIONS)
        .config("spark.executor.extraJavaOptions", JIT_OPTIONS)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, scratch: str | None = None) -> str:
    """The shared folder for checkpoints and scratch tables.

    A folder that the cluster names in ``spark.checkpoint.dir`` (or that the
    caller set on the context) is kept. Without one, ``scratch`` is set; in local
    mode, where driver and executors are one process, a temporary folder will do.
    On a cluster without a folder this is an error: executors would write to disks
    that nobody else can read."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None) or scratch
        if not shared:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("no shared scratch folder: set spark.checkpoint.dir or pass scratch=<URI>")
            shared = tempfile.mkdtemp(prefix="transitlab-ckpt-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
