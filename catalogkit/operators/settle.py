"""Cuts plans where later steps use a table several times, and hints joins with small tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have, once counted, to be broadcast.
SMALL_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session may go without that setting; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="catalogkit-"))
    return sc.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` worked out once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
