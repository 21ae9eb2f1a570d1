"""Cells, headers and rows of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.functions import text as T


def clean_cells(row: Column) -> Column:
    """Null cells become empty; others lose outer white space."""
    return F.transform(row, lambda x: F.coalesce(T.strip(x), F.lit("")))


def column_signature(header: Column) -> Column:
    """Non-empty header cells without white space, joined by a bar."""
    return F.array_join(F.transform(F.filter(header, lambda x: x != ""), T.normalize_heading), "|")


def row_text(row: Column, most: int = 300) -> Column:
    """Non-empty cells joined by " | ", cut to ``most`` characters."""
    return F.substring(F.array_join(F.filter(row, lambda x: x != ""), " | "), 1, most)


def merge_rows(rows: DataFrame) -> DataFrame:
    """Rows (table, ord, cells) to tables: the first row is the header, and its repeats go."""
    seen = rows.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("ord", "cells"))).alias("r")).select("table", F.col("r.cells").alias("r"))
    head = F.col("r")[0]
    return seen.select("table", head.alias("header"), F.filter("r", lambda x: x != head).alias("rows"))


def confidence(fragments: DataFrame, least: float = 0.8) -> DataFrame:
    """Fragments (table, signature) to confidence and needs_review of each table."""
    n = fragments.groupBy("table").agg(F.count("*").alias("n"), F.min("signature").alias("a"), F.max("signature").alias("b"))
    conf = F.when(F.col("n") == 1, 1.0).when(F.col("a") == F.col("b"), 0.95).otherwise(0.7)
    return n.select("table", conf.alias("confidence"), (conf < least).alias("needs_review"))


def near_captions(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """Adds caption to tables (doc, page): the first of their page (doc, page, ord, caption), else of the page before, else empty."""
    first = captions.where("caption <> ''").groupBy("doc", "page").agg(F.min_by("caption", "ord").alias("caption"))
    before = first.select("doc", (F.col("page") + 1).alias("page"), F.col("caption").alias("earlier"))
    return tables.join(first, ["doc", "page"], "left").join(before, ["doc", "page"], "left").withColumn("caption", F.coalesce("caption", "earlier", F.lit(""))).drop("earlier")


def whole_tables(fragments: DataFrame, captions: DataFrame, least: float = 0.8) -> DataFrame:
    """Fragments (doc, page, t, rows) to tables (doc, table, page_start, page_end, caption, header, rows, cross_page, confidence, needs_review).

    A fragment's first row is its header.  Fragments on the same or the next
    page with the same non-empty column signature are one table unless a
    caption starts another; rows that repeat its header go.
    ``captions``: doc, page, ord, caption, empty for other blocks.
    """
    from leafweave.operators.segments import fragment_groups

    named = captions.where("caption <> ''").select("doc", "page").distinct().withColumn("captioned", F.lit(True))
    header = F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>"))
    found = fragments.select("doc", "page", "t", header.alias("header"), F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))).alias("rows"))
    found = found.withColumn("signature", column_signature(F.col("header"))).join(named, ["doc", "page"], "left").withColumn("captioned", F.coalesce("captioned", F.lit(False)))
    pieces = F.array_sort(F.collect_list(F.struct("page", "t", "signature", "header", "rows")))
    whole = fragment_groups(found).groupBy("doc", F.col("grp").cast("long").alias("table")).agg(pieces.alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    alike = F.size(F.array_distinct(F.col("p.signature"))) == 1
    conf = F.when(F.size("p") == 1, 1.0).when(alike, 0.95).otherwise(0.7)
    rows = F.filter(F.flatten("p.rows"), lambda r: r != first["header"])
    out = whole.select("doc", "table", first["page"].alias("page"), first["page"].alias("page_start"), last["page"].alias("page_end"), first["header"].alias("header"), rows.alias("rows"), conf.alias("confidence"))
    out = near_captions(out, captions).drop("page")
    return out.withColumn("cross_page", F.col("page_end") > F.col("page_start")).withColumn("needs_review", F.col("confidence") < least)
