"""Cutting lineage in storage that every executor shares, and size-checked broadcasts."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.lineage import shared_dir

#: Rows of at most a few dozen bytes that may be sent to every executor.
BROADCAST_ROWS = 200_000


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    A lost executor then costs a re-read, not the steps before; columnar files
    are also smaller than checkpointed rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames from cut(); all that was made of them must be written itself by then."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop(df))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def narrow(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows by count, else as it is.

    df should be narrow (keys, counts) and cheap to count, as after cut().
    """
    return F.broadcast(df) if df.count() <= rows else df


def hash_bound(share: float) -> int:
    """The signed 64-bit value that this share of all hashes does not exceed."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)
