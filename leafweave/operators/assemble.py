"""Section text as Markdown: blocks and tables of a section's pages, in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators.sections import content_blocks


def _pages(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(F.col(start) <= F.col(end)).withColumn("page", F.explode(F.sequence(F.col(start), F.col(end))))


def sections(sections: DataFrame, pages: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, section, markdown) of each section.

    ``sections``: doc, section, title, start_page, end_page; ``pages``: doc,
    page, quality; ``blocks``: doc, page, ord, text, role, exclude;
    ``tables``: doc, table (in list order), page_start, page_end, caption,
    markdown.  Only normal pages count, whole pages at a time.  A table is
    rendered once in a section: at the first caption block of the first page
    of its that has one, or behind the blocks of the page on which it starts,
    whichever page comes first.  Caption blocks themselves go.
    """
    normal = pages.where(F.col("quality") == "NORMAL_TEXT").select("doc", "page")
    # both sides are dealt by (doc, page); sections are few a page
    where = _pages(sections.select("doc", "section", "start_page", "end_page"), "start_page", "end_page").select("doc", "section", "page").join(normal, ["doc", "page"])
    own = content_blocks(blocks).select("doc", "page", "ord", T.strip(F.col("text")).alias("text")).where("text <> ''").withColumn("heads", T.caption_like(F.col("text")))
    first = own.where("heads").groupBy("doc", "page").agg(F.min(F.struct("ord", "text")).alias("head"))
    lines = where.join(own.where("not heads"), ["doc", "page"])
    parts = lines.select("doc", "section", _key("page", F.lit(0), "ord"), F.concat("text", F.lit("\n")).alias("part"))
    spans = _pages(tables, "page_start", "page_end").join(first, ["doc", "page"], "left").where("head is not null or page = page_start")
    at = where.join(spans, ["doc", "page"]).groupBy("doc", "section", "table").agg(F.min_by(F.struct("page", "head", "caption", "markdown"), "page").alias("t")).select("doc", "section", "table", "t.*")
    caption = F.when(F.col("head").isNotNull(), F.col("head.text")).otherwise(F.coalesce("caption", F.lit("")))
    # a rendered caption and its table are parts of their own
    text = F.when(caption != "", F.concat(F.lit("\n"), caption, F.lit("\n\n"), "markdown")).otherwise(F.col("markdown"))
    parts = parts.unionByName(at.select("doc", "section", _key("page", F.col("head").isNull().cast("int"), F.coalesce("head.ord", F.lit(0)), "table"), text.alias("part")))
    body = parts.groupBy("doc", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "part"))), lambda x: x["part"]), "\n").alias("body"))
    named = sections.select("doc", "section", F.concat(F.lit("# "), "title", F.lit("\n")).alias("head"))
    return named.join(body, ["doc", "section"], "left").select("doc", "section", F.concat_ws("\n", "head", "body").alias("markdown"))


def _key(page: str, phase: Column, ord_, table="") -> Column:
    """Where a part stands: its page, blocks before leftover tables, the block, the table."""
    return F.struct(F.col(page).cast("long").alias("page"), phase.alias("phase"), (F.col(ord_) if isinstance(ord_, str) else ord_).cast("long").alias("ord"), (F.col(table) if table else F.lit(-1)).cast("long").alias("table")).alias("key")
