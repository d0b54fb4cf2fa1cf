"""Keys that rows share, each with one member as its hub; no row of a key meets all the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.durable import BROADCAST_ROWS, cut, discard, narrow

#: Bits of a bitmap that is sent to all tasks, whatever it tells of.
FILTER = 1 << 27


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """FILTER bits, those set that the 64-bit hashes of a column fall on. At most FILTER / 32 rows are collected, whatever the table."""
    bit = F.pmod(key, F.lit(FILTER))
    parts = keys.groupBy(F.floor(bit / 32).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int"))).alias("bits"))
    out = np.zeros(FILTER // 32, np.uint32)
    for batch in parts.toArrow().to_batches():
        out[batch.column("at").to_numpy()] = batch.column("bits").to_numpy().astype(np.uint32)
    return out


def sieved(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that may have one of keys(key): all that do, and a few others."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(keys, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at = batch.column("key").to_numpy() & (FILTER - 1)
            yield batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0))

    return rows.mapInArrow(run, rows.schema)


def live(rows: DataFrame, sieve: bool = False) -> DataFrame:
    """key, hub, node, probe and the other columns, for rows(key, node, probe, ...) of keys with several nodes, one of which at least is no
    probe. The hub is the smallest such node and has no row of its own.

    Hubs are partial minima, so a key with any part of the rows is one row of each task before the shuffle;
    the rows then join with the hubs, by broadcast behind a count, else by a shuffle that Spark splits. With sieve (keys are then never null),
    that shuffle gets only rows that a bitmap of the hubs' keys lets through.
    """
    hubs = rows.groupBy("key").agg(F.min(F.when(~F.col("probe"), F.col("node"))).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high"))
    hubs = cut(hubs.filter("hub IS NOT NULL AND low <> high").select("key", "hub"))
    if sieve and hubs.count() > BROADCAST_ROWS:
        rows = sieved(rows, hubs)
    others = [c for c in rows.columns if c not in ("key", "node", "probe")]
    out = cut(rows.join(narrow(hubs), "key").filter("node <> hub").groupBy("key", "hub", "node", *others).agg(F.min("probe").alias("probe")))
    discard(hubs)
    return out


def crowded(members: DataFrame, free: str, bound: int) -> DataFrame:
    """key: those with more than `bound` members for which `free` holds."""
    return cut(members.groupBy("key").agg(F.count_if(F.expr(free)).alias("n")).filter(F.col("n") > bound).select("key"))


#: Documents that tell which keys are hot, and the share of their rows from which a key is.
TOLD_BY, HOT_SHARE = 20_000, 0.001
SPREAD = 256


def shared_by_several(docs: DataFrame, filed: Callable[[DataFrame], DataFrame], n_docs: int, apart: bool) -> DataFrame:
    """The rows filed(docs) = (key, passage, doc_id, at) of keys that several rows have; if apart, rows of different documents.

    Rows meet their key's others in one window, so that each crosses the network once. A key that a few documents
    already show to be shared and to have more than HOT_SHARE of the rows needs no count: there are at most
    1 / HOT_SHARE of these, they are known to all tasks, and their rows are spread by salt. Which keys
    are found so changes only the way of the rows, not the result.
    """
    few = docs.sample(min(1.0, TOLD_BY / max(n_docs, 1)), seed=1)
    seen = filed(few).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    seen = cut(seen.filter("n > 1 AND low < high" if apart else "n > 1"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = seen.filter(F.col("n") > F.greatest(F.lit(HOT_SHARE * total), F.lit(100))).select("key", F.lit(True).alias("hot"))
    rows = filed(docs).join(F.broadcast(hot), "key", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SPREAD))).otherwise(F.lit(0))
    by_key = W.partitionBy("key", salt)
    if apart:
        several = F.min("doc_id").over(by_key) < F.max("doc_id").over(by_key)
    else:
        several = F.count(F.lit(1)).over(by_key) > 1
    return rows.withColumn("several", F.coalesce("hot", several)).filter("several").select("key", "passage", "doc_id", "at")
