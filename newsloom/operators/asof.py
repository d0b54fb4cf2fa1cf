"""As-of joins: for each row, the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microseconds of a block; a key's rows are sorted within blocks, and blocks pass on their last row.
SPAN = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, tie: str, span: int = SPAN) -> DataFrame:
    """left with `right_row`, a struct of the columns of right (null: none): of its rows with the same `by`, the one with the largest (at, tie) not after left's `at`.

    No range join: both sides are united and sorted once, and the last row seen is carried on. A key of any
    size is sorted in blocks of time; only one row a block meets the key's other blocks.
    """
    row = F.struct(*[F.col(c) for c in right.columns])
    mine = left.select(F.col(by).alias("_by"), F.unix_micros(at).alias("_at"), F.struct("*").alias("_left"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("_right"))
    other = right.select(F.col(by).alias("_by"), F.unix_micros(at).alias("_at"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"), row.alias("_right"))
    # a row of right goes before rows of left at the same time
    both = mine.unionByName(other).withColumn("_block", F.floor(F.col("_at") / span)).withColumn("_key", F.when(F.col("_right").isNotNull(), F.struct(F.col("_at").alias("at"), F.col(f"_right.{tie}").alias("tie"), F.col("_right").alias("row"))))
    blocks = both.groupBy("_by", "_block").agg(F.max("_key").alias("_of"))
    ahead = blocks.select("_by", "_block", F.last("_of", True).over(W.partitionBy("_by").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_ahead"))
    order = W.partitionBy("_by", "_block").orderBy("_at", F.col("_right").isNull(), F.col("_key.tie"))
    near = both.withColumn("_near", F.last("_key", True).over(order.rowsBetween(W.unboundedPreceding, 0))).filter("_left IS NOT NULL")
    # null keys meet nothing
    found = near.join(ahead, ["_by", "_block"], "left").select("_left.*", F.coalesce("_near.row", "_ahead.row").alias("_found"), "_by", "_at")
    usable = F.col("_by").isNotNull() & F.col("_at").isNotNull()
    return found.withColumn("right_row", F.when(usable, F.col("_found"))).drop("_found", "_by", "_at")
