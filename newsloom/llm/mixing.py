"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source gets a target of words by its weight, at most `cap` times its size,
with what is over shared again. The targets become integer quotas of blocks:
seat k + 1 of a party has the quotient weight / (2k + 1), and the highest
quotients win. First the sources compete, then, within each source, its shards.
A shard orders its documents by a seeded hash and takes its quota of blocks from
a seeded starting block on, going round at most `cap` times.

Only DataFrame and SQL functions are used. One source may hold any part of the
rows: it is counted with partial sums and laid out by shards, whose number
follows the number of documents.

Defined results: null text has size 0 and takes part with it; null is a source of
its own, last in order; a source without words gets target 0; repeated rows are
counted each; an empty table gives no rows; other columns are ignored unless they
are asked for by name, and then those named like a result give way to it (doc_id must
be a key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.durable import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 16
SEED = 20_240_601
SHARD_DOCS = 100_000


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sources(source, source_size) with weight and target.

    Sharing again until nobody is above the cap fills a level: with the sources
    ordered by size / weight, the first few are at their cap and the rest get
    level * weight. One row per source; it is far smaller than the documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(listed, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    )
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weight"))
    up = W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.join(F.broadcast(total))  # one row
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(up), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(up), F.lit(0)))
    )
    rest = F.lit(share) * F.col("total") - F.lit(float(cap)) * F.col("full_before")
    left = F.col("all_weight") - F.col("weight_before")
    return (
        s.withColumn("capped", F.lit(float(cap)) * F.col("source_size") * left <= rest * F.col("weight"))
        # the level is that of the first source below its cap; later ones share it
        .withColumn("rest", F.max(F.when(~F.col("capped"), F.struct((-F.col("weight_before")).alias("o"), rest.alias("rest"), left.alias("left")))).over(W.partitionBy()))
        .withColumn("target", F.when(F.col("capped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("weight") * F.col("rest.rest") / F.col("rest.left")))
        .select("source", "rank", "source_size", "weight", "target")
    )


def apportion(parties: DataFrame, group: list[str], party: str, claim: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: adds out, the seats of each party of a group, which add up to the group's `seats`.

    A party's seats differ from its exact share by at most the share times
    n / (2 * seats), and 1: only quotients of that range compete. Ties go to the
    smaller party. There are about 4 rows for a party.
    """
    whole = W.partitionBy(*group)
    p = (
        parties.withColumn("_claims", F.sum(claim).over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_share", F.when(F.col("_claims") > 0, F.col(claim) * F.col(seats) / F.col("_claims")).otherwise(F.lit(0.0)))
        .withColumn("_slack", F.col("_share") * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1))) + 2)
        .withColumn("_low", F.greatest(F.floor(F.col("_share") - F.col("_slack")), F.lit(0)))
        .withColumn("_high", F.ceil(F.col("_share") + F.col("_slack")))
        .withColumn("_free", F.col(seats) - F.sum("_low").over(whole))
    )
    won = (
        p.filter(F.col(claim) > 0)
        .select(*group, party, claim, "_free", F.explode(F.sequence("_low", "_high")).alias("_k"))
        .withColumn("_place", F.row_number().over(W.partitionBy(*group).orderBy((F.col(claim) / (2 * F.col("_k") + 1)).desc(), party)))
        .filter(F.col("_place") <= F.col("_free"))
        .groupBy(*group, party)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    keys = [*group, party]
    return (
        p.join(won, keys, "left")
        .withColumn(out, F.when(F.col(claim) > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("long"))
        .drop("_claims", "_n", "_share", "_slack", "_low", "_high", "_free", "_won")
    )


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the columns of keep."""
    shards = max(4, -(-docs.count() // SHARD_DOCS))
    sized = cut(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int").alias("shard"),
        )
    )
    cells = sized.groupBy("source", "shard").agg(F.sum("size").alias("cell"))
    sources = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("_all", F.lit(0)).withColumn("_seats", F.round(F.sum("target").over(W.partitionBy("_all")) / block).cast("long"))
    sources = apportion(sources, ["_all"], "rank", "target", "_seats", "quota").drop("_all", "_seats")
    cells = cells.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = sources.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    cells = apportion(cells.join(sources, "_key"), ["_key"], "shard", "cell", "quota", "blocks")
    cells = (
        cells.withColumn("words", F.least(F.col("blocks") * block, F.col("cell") * cap))
        .withColumn("rounds", F.when(F.col("cell") > 0, F.floor(F.col("words") / F.col("cell"))).otherwise(F.lit(0)))
        .withColumn("more", F.col("words") - F.col("rounds") * F.col("cell"))
        .withColumn("first", F.pmod(F.xxhash64(F.lit(seed), "_key", "shard"), F.greatest(F.floor(F.col("cell") / block), F.lit(1))) * block)
        .select("_key", "shard", "cell", "source_size", "target", "rounds", "more", "first")
    )
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    laid = sized.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    end = F.col("at") + F.col("size")

    def within(low: Column, high: Column) -> Column:
        return F.greatest(F.least(end, high) - F.greatest(F.col("at"), low), F.lit(0))

    last = F.col("first") + F.col("more")
    mixed = laid.join(cells, ["_key", "shard"]).withColumn(
        "taken", (F.col("rounds") * F.col("size") + within(F.col("first"), F.least(last, F.col("cell"))) + within(F.lit(0), last - F.col("cell"))).cast("long")
    )
    out = mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")
    if not keep:
        return out
    kept = [c for c in keep if c not in out.columns]
    # joined as one value, so that its columns may have any name
    texts = docs.select("doc_id", F.struct(*kept).alias("kept")) if kept else docs.select("doc_id", F.struct(F.lit(0)).alias("kept"))
    out = out.select(F.col("doc_id").alias("_id"), F.struct(*out.columns).alias("_mix"))
    both = texts.join(out, F.col("doc_id").eqNullSafe(F.col("_id")))
    mixed = ("size", "source_size", "target", "taken")
    return both.select("doc_id", *[F.col("kept").getField(c).alias(c) for c in kept], *[F.col("_mix").getField(c).alias(c) for c in mixed])


#: DuckDB, for all that is fixed: not for `taken`, which depends on Spark's hash.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ([3, 1, 2])[((rank - 1) % 3 + 1)::INT] AS weight FROM r),
u AS (SELECT *, coalesce(sum(source_size) OVER up, 0)::BIGINT AS full_before, coalesce(sum(weight) OVER up, 0)::BIGINT AS weight_before,
        (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_weight
      FROM w WINDOW up AS (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 1.5::DOUBLE * total - 2.0::DOUBLE * full_before AS rest, all_weight - weight_before AS share_left FROM u),
k AS (SELECT *, 2.0::DOUBLE * source_size * share_left <= rest * weight AS capped FROM c),
f AS (SELECT rest, share_left FROM k WHERE NOT capped ORDER BY weight_before LIMIT 1),
t AS (SELECT k.source, k.source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE weight * f.rest / f.share_left END AS target FROM k LEFT JOIN f ON true)
SELECT d.doc_id, d.size, t.source_size, t.target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
