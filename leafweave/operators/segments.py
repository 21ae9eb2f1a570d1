"""Runs, intervals and sessions over ordered rows of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_length(rows: DataFrame, label: str = "label") -> DataFrame:
    """(doc, page, label) to segments: seq, label, start_page, end_page, n_pages."""
    w = Window.partitionBy("doc").orderBy("page")
    new = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(1))
    runs = rows.withColumn("new", new).withColumn("seq", F.sum("new").over(w))
    return runs.groupBy("doc", "seq", label).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("n_pages"))


def forward_fill(rows: DataFrame, label: str = "label", default: str = "CONTRACT_BODY") -> DataFrame:
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(label, F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(default)))


def interval_ends(titles: DataFrame) -> DataFrame:
    """Titles (doc, page, ord, last_page) to intervals: an end is the same page, or the page before the next title."""
    w = Window.partitionBy("doc").orderBy("page", "ord")
    nxt = F.lead("page").over(w)
    end = F.when(nxt.isNull(), F.col("last_page")).when(nxt == F.col("page"), F.col("page")).otherwise(nxt - 1)
    return titles.withColumn("end_page", end).withColumn("next_ord", F.coalesce(F.lead("ord").over(w), F.lit(-1)))


def fragment_groups(fragments: DataFrame) -> DataFrame:
    """Adds grp to fragments (doc, page, t, signature, captioned): one joins the one before with the same signature on the same or the next page, unless its page has a caption."""
    w = Window.partitionBy("doc").orderBy("page", "t")
    gap = F.col("page") - F.lag("page").over(w)
    same = (F.lag("signature").over(w) == F.col("signature")) & (F.col("signature") != "") & gap.isin(0, 1) & ~F.col("captioned")
    return fragments.withColumn("grp", F.sum(F.when(same, 0).otherwise(1)).over(w))


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Fragments to tables: doc, grp, page_start, page_end, n_fragments, cross_page, confidence."""
    agg = fragment_groups(fragments).groupBy("doc", "grp").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_fragments"), F.countDistinct("signature").alias("kinds"))
    conf = F.when(F.col("n_fragments") == 1, 1.0).when(F.col("kinds") == 1, 0.95).otherwise(0.7)
    return agg.withColumn("cross_page", F.col("page_end") > F.col("page_start")).withColumn("confidence", conf).drop("kinds")
