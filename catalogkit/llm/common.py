"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension table is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 50_000
#: Bytes of such a table where its rows have no size of their own.
BROADCAST_BYTES = 32 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may go without that setting
    and gets a folder of its own; on a cluster its absence is an error.
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


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its schema.

    Unlike a checkpoint it is compressed and columnar, so later passes read
    only the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(dim: DataFrame, rows: int | None = None) -> DataFrame:
    """``dim`` with a broadcast hint if it is counted to be small, else as it is.

    Beyond the bound the join shuffles and adaptive execution splits hot keys.
    """
    n = dim.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(dim) if n <= BROADCAST_ROWS else dim


def is_small(dim: DataFrame) -> bool:
    """Whether ``dim``, counted, has at most BROADCAST_ROWS rows and, written out, BROADCAST_BYTES bytes."""
    written_out = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    seen = dim.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), written_out.alias("bytes")).first()
    return seen["n"] <= BROADCAST_ROWS and (seen["bytes"] or 0) <= BROADCAST_BYTES


def bounded(dim: DataFrame) -> DataFrame:
    """``dim`` with a broadcast hint if ``is_small``, for rows that hold lists or long texts; else it is joined by a shuffle."""
    return F.broadcast(dim) if is_small(dim) else dim


def lower_ascii(c):
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def token() -> str:
    """A name for what one call shares with the executors."""
    return uuid.uuid4().hex
