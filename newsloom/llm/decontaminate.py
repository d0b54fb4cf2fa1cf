"""Benchmark decontamination by spaced-seed hashing.

A mask picks some of the tokens in a short stretch and ignores the others, so a
substituted token at an ignored position does not matter. Masks are hashed at
every position of the benchmark items and of the documents and joined; each hit
names an item, a document and the shift between them. Along that shift the tokens
are compared, and the pair counts if some stretch of WINDOW tokens agrees in all
but SLACK of them. MASKS is lossless for that: any SLACK substitutions in WINDOW
tokens leave one mask untouched (tests try all of them).

Only DataFrame and SQL functions are used. Positions are exploded, hashed and
probed inside one stage; no row leaves it unless a seed is hit. The benchmark is
sent to all executors if it has at most SEED_ROWS seeds. Else seeds are joined by
shuffle, as narrow rows without tokens, and the documents that are hit give theirs after.

Tokens are runs of letters and digits, lower-cased. Defined results: null or empty
texts hit nothing; items of fewer than WINDOW tokens have no window, so `leaks` looks for
them word for word, by a hash of all their tokens for each length; repeated items and documents report once for each id; a null doc_id or item_id names nothing and is
reported by no row, however the seeds are joined; empty tables give no rows; only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 12
SLACK = 2
#: Offsets of the tokens that each mask reads.
MASKS = ((0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 3, 4, 7, 8))
SEED_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives an empty array."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def seeded(df: DataFrame, keep: list[str], masks=MASKS) -> DataFrame:
    """A row for each position and mask: the columns of keep, pos (from 0), seed."""
    at = lambda o: F.get("w", F.col("pos") + o)
    seeds = [F.xxhash64(F.lit(m), *[at(o) for o in mask]) for m, mask in enumerate(masks)]
    n = F.size("w") - (min(m[-1] for m in masks) + 1)
    columns = list(dict.fromkeys((*keep, "w")))
    return (
        df.filter(n >= 0)
        .select(*columns, F.explode(F.sequence(F.lit(0), n)).alias("pos"))
        .select(*keep, "pos", F.explode(F.array(*seeds)).alias("seed"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK, masks=MASKS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """doc_id, item_id, n_equal (tokens that agree at the best shift), item_tokens: the pairs that overlap."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("w")).filter(F.size("w") >= window)
    probes = seeded(items.withColumn("n_item", F.size("w")), ["item_id", "n_item"], masks).withColumnRenamed("pos", "item_pos").distinct()
    tokened = docs.filter("doc_id IS NOT NULL").select("doc_id", tokens(F.col("text")).alias("w"))
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    # the document's tokens beside the item, the same for all hits of a pair and shift
    there = F.slice("w", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n_item") + F.least(F.col("shift"), F.lit(0))).alias("there")
    if probes.count() <= seed_rows:
        items = F.broadcast(items)
        hits = seeded(tokened, ["doc_id", "w"], masks).join(F.broadcast(probes), "seed").select("doc_id", "w", "item_id", "n_item", shift)
    else:
        hits = seeded(tokened, ["doc_id"], masks).join(probes, "seed").select("doc_id", "item_id", "n_item", shift).distinct().join(tokened, "doc_id")
    hits = hits.select("doc_id", "item_id", "shift", there).distinct()
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    equal = F.filter(
        F.transform("w", lambda x, j: F.when(x == F.get("there", (j - skipped).cast("int")), j)),
        lambda j: j.isNotNull(),
    )
    need = window - slack
    close = F.exists(F.transform("equal", lambda j, k: F.get("equal", k + (need - 1)) - j < window), lambda ok: ok)
    return (
        hits.join(items, "item_id")
        .withColumn("equal", equal)
        .filter(close)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.size("equal")).cast("long").alias("n_equal"), F.max(F.size("w")).cast("long").alias("item_tokens"))
    )


def short_copies(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame | None:
    """The columns of contaminated() for items of 1 to window - 1 tokens that stand whole in a document; None if there are no such items."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("item")).withColumn("n", F.size("item")).filter((F.col("n") > 0) & (F.col("n") < window))
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    if not lengths:
        return None
    items = items.withColumn("seed", F.xxhash64("item"))
    if items.count() <= SEED_ROWS:
        items = F.broadcast(items)
    return (
        docs.filter("doc_id IS NOT NULL")
        .select("doc_id", tokens(F.col("text")).alias("w"))
        .filter(F.size("w") > 0)
        .select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("pos"))
        .select("doc_id", "w", "pos", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
        .filter(F.col("pos") + F.col("n") - 1 <= F.size("w"))
        .select("doc_id", F.slice("w", F.col("pos"), F.col("n")).alias("there"), "n")
        .withColumn("seed", F.xxhash64("there"))
        .join(items, ["seed", "n"])
        .filter("there = item")
        .select("doc_id", "item_id", F.col("n").cast("long").alias("n_equal"), F.col("n").cast("long").alias("item_tokens"))
        .distinct()
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contaminated() and the copies of items that are shorter than its window."""
    long, short = contaminated(docs, benchmark), short_copies(docs, benchmark)
    return long if short is None else long.unionByName(short)


ORACLE_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
bi AS (SELECT item_id, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS j FROM b WHERE len(w) >= 12),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
di AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
e AS (SELECT doc_id, item_id, n, i - j AS shift, j FROM di JOIN bi USING (t)),
q AS (SELECT *, lead(j, 9) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) - j AS span, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS equal FROM e),
o AS (SELECT doc_id, item_id, max(equal) AS equal, max(n) AS n FROM q WHERE doc_id IS NOT NULL GROUP BY doc_id, item_id, shift HAVING min(span) < 12)
SELECT doc_id, item_id, max(equal)::BIGINT AS n_equal, max(n)::BIGINT AS item_tokens FROM o GROUP BY doc_id, item_id
"""
