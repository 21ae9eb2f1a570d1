"""Running headers and footers: repeated patterns on consecutive pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafweave.functions import text as T


def band_candidates(blocks: DataFrame, header: float = 0.12, footer: float = 0.12) -> DataFrame:
    """Adds role to blocks (y0, height, text) in the page's edge bands; others go."""
    role = F.when(F.col("y0") < F.col("height") * header, "RUNNING_HEADER").when(F.col("y0") > F.col("height") * (1 - footer), "RUNNING_FOOTER")
    return blocks.withColumn("role", role).where(F.col("role").isNotNull() & (F.length(T.strip(F.col("text"))) > 0))


def families(candidates: DataFrame, least: int = 2) -> DataFrame:
    """(doc, role, pattern, first_page, last_page) of runs of consecutive pages; least holds for blocks and for a run's pages."""
    rows = candidates.withColumn("pattern", T.normalize_pattern(F.col("text"))).where(F.length("pattern") >= 2)
    key = ["doc", "role", "pattern"]
    pages = rows.groupBy(*key, "page").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("page")
    runs = pages.withColumn("total", F.sum("n").over(Window.partitionBy(*key))).where(F.col("total") >= least).withColumn("island", F.col("page") - F.row_number().over(w))
    return runs.groupBy(*key, "island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages")).where(F.col("n_pages") >= least).drop("island")


def mark(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Gives blocks of a family on its pages the family's role, others BODY."""
    fam = found.select("doc", "role", "pattern", F.explode(F.sequence("first_page", "last_page")).alias("page")).distinct()
    rows = blocks.withColumn("pattern", T.normalize_pattern(F.col("text")))
    return rows.join(fam.withColumnRenamed("role", "family_role"), ["doc", "page", "pattern"], "left").withColumn("role", F.coalesce("family_role", F.lit("BODY"))).drop("family_role", "pattern")


def family_blocks(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, family, role, pattern, page, ord): the blocks of each family, numbered through a document, headers before footers, by first occurrence."""
    runs = found.select("doc", "role", "pattern", F.explode(F.sequence("first_page", "last_page")).alias("page")).distinct()
    rows = candidates.withColumn("pattern", T.normalize_pattern(F.col("text"))).join(runs, ["doc", "role", "pattern", "page"], "left_semi")
    first = rows.groupBy("doc", "role", "pattern").agg(F.min(F.struct("page", "ord")).alias("at"))
    order = Window.partitionBy("doc").orderBy((F.col("role") != "RUNNING_HEADER").cast("int"), "at", "pattern")
    return rows.join(first.select("doc", "role", "pattern", F.row_number().over(order).alias("family")), ["doc", "role", "pattern"]).select("doc", "family", "role", "pattern", "page", "ord")
