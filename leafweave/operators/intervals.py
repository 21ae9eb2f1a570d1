"""Page intervals against pages; every join is an equi join on exploded pages, never a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pages_of(rows: DataFrame, start: str = "start_page", end: str = "end_page", at_most: int | None = None) -> DataFrame:
    """A row for each page of an interval, or for its first ``at_most`` pages; an empty interval gives none."""
    last = F.col(end) if at_most is None else F.least(F.col(end), F.col(start) + at_most - 1)
    return rows.where(F.col(start) <= F.col(end)).withColumn("page", F.explode(F.sequence(F.col(start), last)))


def first_covering(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section to tables (doc, page): the first in list order (seq) whose pages hold it, else -1."""
    first = pages_of(sections).groupBy("doc", "page").agg(F.min("seq").alias("section"))
    return tables.join(first, ["doc", "page"], "left").withColumn("section", F.coalesce("section", F.lit(-1)))


def clean_only(sections: DataFrame, pages: DataFrame, bad: tuple[str, ...] = ("G", "I")) -> DataFrame:
    """Sections (doc, seq, ...) without a page of a bad class."""
    hit = pages.where(F.col("c").isin(*bad)).select("doc", "page")
    dirty = pages_of(sections).join(hit, ["doc", "page"], "left_semi").select("doc", "seq").distinct()
    return sections.join(dirty, ["doc", "seq"], "left_anti")


def extend(pages: DataFrame, anchor: str, stop: str) -> DataFrame:
    """Pages from the first of class ``anchor`` on, up to the first later page of class ``stop``."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    seen = pages.withColumn("seen", F.max(F.col("c") == anchor).over(w)).where("seen")
    return seen.withColumn("stopped", F.max(F.col("c") == stop).over(w)).where("not stopped").drop("seen", "stopped")
