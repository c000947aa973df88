"""Session helpers: test sessions, the checkpoint folder, table loading."""

from __future__ import annotations

import logging
import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def logger(name: str, interactive: bool = False) -> Callable[[str], None]:
    """Writes messages to the log `tilery.NAME`, which is off unless a handler takes it, or to the console of a person at work."""
    if interactive:
        return print
    log = logging.getLogger(f"tilery.{name}")
    log.addHandler(logging.NullHandler())
    return log.debug


def local_session(cores: int = 4, shuffle_partitions: int = 8, name: str = "tilery") -> SparkSession:
    """A local session for tests and benches; never used on a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TILERY_DRIVER_MEMORY", "6g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the shared folder the cluster names in spark.checkpoint.dir; only a session that names none
    (a test on one machine) gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    # executors of local-cluster[...] are other processes
    if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tilery-checkpoint-"))


def durable(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint: later readers survive the loss of any executor. Spark removes the files
    when nothing refers to the frame any more, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, for steps whose rows are small and dear: adaptive execution would put them together by
    their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
