"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.durable import BROADCAST_ROWS, cut, discard


def _stars(edges: DataFrame) -> bool:
    """Whether no larger end of edges(a, b) has another edge: then each component is a star around its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("larger")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("larger")))
    seen = ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count_if(F.col("larger") == 0).alias("smaller"))
    return not seen.filter("larger > 1 OR larger = 1 AND smaller > 0").count()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest member) for each end of links(a, b).

    Alternates two rewritings until the links are stars: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours and itself. The
    number of rounds follows the logarithm of a component's size; links that are stars
    need none. Each round is two partial minima and two joins on a node, to which few minima
    are sent whole; else adaptive execution splits them where a node has many links. Few links
    are written by as many tasks as there are cores. No round adds links.
    """
    few = 2 * links.count() <= BROADCAST_ROWS  # each link has two nodes
    sent = F.broadcast if few else lambda x: x
    cores = links.sparkSession.sparkContext.defaultParallelism
    by_few = lambda x: x.coalesce(cores) if few else x
    edges = cut(by_few(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(sent(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large if few else large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(low), "a")
        link = lambda x: F.struct(F.greatest(x, "m").alias("a"), F.least(x, "m").alias("b"))
        stars = small.select(F.inline(F.array(link("a"), link("b"))))
        last, edges = edges, cut(by_few(stars.filter("a <> b").distinct()))
        discard(last)
    tops = by_few(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
