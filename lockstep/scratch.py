"""Shared scratch space for intermediate tables and checkpoints."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is named, a temporary one serves a local master; on a cluster, whose executors
    would not share it, that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lockstep-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, one per call."""
    return f"{checkpoint_root(spark)}/lockstep/{label}-{uuid.uuid4().hex}"
