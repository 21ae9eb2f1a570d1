"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm import workdir


def _stars(pairs: DataFrame, up: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones if ``up``, else the smaller ones and itself) to the least of them all."""
    if up:
        near = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = near.join(least, "a")
    if up:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) between long ids: node, root, where root is the least id reachable.

    Nodes without a link aren't listed.  Each round is two joins on a node id,
    with combining aggregates, and is written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain.
    """
    pairs = workdir.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        pairs = workdir.cut(_stars(_stars(pairs, up=True), up=False))
