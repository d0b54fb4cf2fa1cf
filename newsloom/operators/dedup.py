"""Near-duplicate articles: MinHash signatures, bands, and first-wins selection.

Signatures are PERMUTATIONS minima of (a * h + b) mod P over the hashes h of an article's
shingles, which are joined from hashes of their words; an article without shingles has the sentinel P throughout, so all such articles
look alike. Two articles collide if they share one of BANDS bands of ROWS minima, and an
article is a duplicate if it collides with an earlier one that was kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from newsloom.functions import text
from newsloom.lineage import checkpointed

P = 2**31 - 1
PERMUTATIONS, BANDS, ROWS = 128, 25, 5


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """a and b of each permutation, from a multiplicative generator."""
    out, x = [], 20_231_127
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = x * 48_271 % P
            pair.append(x)
        out.append((pair[0], pair[1]))
    return out


#: Multiplier that joins the hashes of a shingle's words.
JOIN = 48_271
#: Shingles whose minima are taken together.
CHUNK = 256
#: Words, and so articles, whose signatures are taken together.
WORDS = 1 << 17


def _word_hashes(words: pa.Array) -> np.ndarray:
    """The first 32 bits of each word's md5, modulo P; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    first = b"".join([hashlib.md5(x.encode()).digest()[:4] for x in coded.dictionary.to_pylist()])
    return (np.frombuffer(first, ">u4").astype(np.int64) % P)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def _minima(words: pa.ListArray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of minima for each list: over its n-word shingles, P without any."""
    off = words.offsets.to_numpy().astype(np.int64)
    hashes = _word_hashes(words.values.slice(off[0], off[-1] - off[0]))
    off -= off[0]
    out = np.full((len(words), len(a)), P, np.int64)
    if len(hashes) < n:
        return out
    joined = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        joined = (joined * JOIN + hashes[k : k + len(joined)]) % P
    count = np.maximum(np.diff(off) - n + 1, 0)
    for i in np.flatnonzero(count):
        own = np.unique(joined[off[i] : off[i] + count[i]])
        for c in range(0, len(own), CHUNK):
            # modulo 2**31 - 1 by shift and add, which is faster than by division; what is P or more is less once P is taken off, all else wraps round
            x = own[c : c + CHUNK, None] * a + b
            x = ((x & P) + (x >> 31)).view(np.uint64)
            out[i] = np.minimum(out[i], np.minimum(x, x - np.uint64(P)).min(0).view(np.int64))
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose last column, lists, holds WORDS words at most, or one article."""
    off = batch.column(batch.num_columns - 1).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(off, off[at] + WORDS, "right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def signatures(articles: DataFrame, n: int = 4) -> DataFrame:
    """articles (with title and body) and their signature: array<bigint>.

    Words are parted by Spark; they are hashed and their shingles' minima taken in one Arrow map. Every
    column given goes through it, so callers select what they need first.
    """
    pairs = coefficients()
    a = np.array([p[0] for p in pairs], np.int64)
    b = np.array([p[1] for p in pairs], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            out = _minima(batch.column(batch.num_columns - 1), n, a, b)
            signature = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), len(pairs)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], signature], names=[*batch.schema.names[:-1], "signature"])

    content = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    schema = StructType([*articles.schema.fields, StructField("signature", ArrayType(LongType()))])
    return articles.select("*", text.words(F.lower(content)).alias("_words")).mapInArrow(run, schema)


def band_keys(signature: Column) -> Column:
    bands = [F.concat(F.lit(f"{i}:"), F.md5(F.array_join(F.slice(signature, i * ROWS + 1, ROWS), ","))) for i in range(BANDS)]
    return F.array(*bands)


def leaders(signed: DataFrame, order: str = "arrival") -> DataFrame:
    """The first article of each signature; the others are copies of it as far as signatures tell."""
    return signed.groupBy("signature").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def candidate_pairs(signed: DataFrame, order: str = "arrival") -> DataFrame:
    """a, b, bands: pairs of leaders that share bands. Copies are not expanded."""
    bands = leaders(signed, order).select(order, F.explode(band_keys(F.col("signature"))).alias("band"))
    crowded = bands.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("band"))).filter("n > 1").drop("n")
    other = crowded.select(F.col(order).alias("b"), "band")
    return crowded.withColumnRenamed(order, "a").join(other, "band").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("bands"))


def first_wins(signed: DataFrame, order: str = "arrival") -> DataFrame:
    """order, is_duplicate. signed has order, signature, publishable.

    What is not publishable can be a duplicate but never makes one. No pairs are made:
    each round, every band passes on its first kept and its first undecided publishable
    article, and an article that nobody undecided precedes is decided. Of one signature,
    all after the first publishable article are duplicates, whatever becomes of that.
    """
    same = W.partitionBy("signature")
    marked = signed.select(order, "signature", "publishable").withColumn("first", F.min(F.when(F.col("publishable"), F.col(order))).over(same))
    late = F.col(order) > F.coalesce("first", F.col(order))
    marked = checkpointed(marked.withColumn("late", late))
    open_ = marked.filter(~F.col("late")).select(order, "publishable", F.explode(band_keys(F.col("signature"))).alias("band"))
    crowded = checkpointed(open_.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("band"))).filter("n > 1").drop("n"))
    state = crowded.select(order, "publishable").distinct().withColumn("state", F.lit("open"))
    state = checkpointed(state)
    while state.filter("state = 'open'").limit(1).count():
        rows = crowded.join(state.drop("publishable"), order)
        heads = rows.groupBy("band").agg(
            F.min(F.when(F.col("state") == "kept", F.col(order))).alias("kept"), F.min(F.when((F.col("state") == "open") & F.col("publishable"), F.col(order))).alias("open")
        )
        seen = rows.filter("state = 'open'").join(heads, "band").groupBy(order).agg(F.min("kept").alias("kept"), F.min("open").alias("open"))
        me = F.col(order)
        decided = (
            F.when(F.col("kept") < me, "duplicate").when(F.col("open") < me, "open").when(F.col("publishable"), "kept").otherwise("free")
        )
        state = checkpointed(state.join(seen, order, "left").withColumn("state", F.when(F.col("state") == "open", decided).otherwise(F.col("state"))).drop("kept", "open"))
    return marked.join(state.select(order, "state"), order, "left").select(order, (F.col("late") | (F.coalesce("state", F.lit("")) == "duplicate")).alias("is_duplicate"))


def similar(signed: DataFrame, threshold: float | None = None, order: str = "arrival") -> DataFrame:
    """a, b, estimate for colliding leaders; the reference behaviour keeps all, a threshold is an extension."""
    s = leaders(signed, order)
    pairs = candidate_pairs(signed, order).join(s.select(F.col(order).alias("a"), F.col("signature").alias("sa")), "a").join(s.select(F.col(order).alias("b"), F.col("signature").alias("sb")), "b")
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) / PERMUTATIONS
    pairs = pairs.withColumn("estimate", equal).select("a", "b", "estimate")
    return pairs.filter(F.col("estimate") >= threshold) if threshold is not None else pairs


def cache_stats(kept: DataFrame, max_size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return kept.agg(n.alias("size"), F.lit(max_size).cast("long").alias("max_size"), F.lit(PERMUTATIONS).cast("long").alias("permutations"), (n * 100.0 / max_size).alias("usage_percent"))
