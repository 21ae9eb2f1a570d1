"""Titles, priorities and categories of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.functions import text as T

# Closed sets of names.
CATEGORIES = ("SCOPE", "DELIVERABLE", "MILESTONE", "CONSTRAINT", "QUALITY", "MAINTENANCE", "MANAGEMENT", "WORK", "MEETING", "ACCEPTANCE", "PAYMENT", "TRAINING", "SECURITY_ACTIVITY", "TRANSITION", "UNCLASSIFIED")
EXCLUDED_TYPES = ("BID_INSTRUCTIONS", "EVALUATION_GUIDELINES", "TENDER_ANNOUNCEMENT", "LAW_OR_POLICY")
WEIGHTY_IN_ATTACHMENTS = ("DELIVERABLE", "QUALITY", "MILESTONE", "MAINTENANCE", "ACCEPTANCE", "PAYMENT", "TRAINING", "TRANSITION")
NOT_CONTENT = ("RUNNING_HEADER", "RUNNING_FOOTER", "PAGE_NUMBER")

_ARTICLE = "第[一二三四五六七八九十百]+條"
#: (document type, pattern of number and title, what stands between them, least font size, contents lines rejected)
TITLE_RULES = (
    ("REQUIREMENT_SPECIFICATION", r"^([壹貳參肆伍陸柒捌玖拾])[、.．,](.+)", "、", 13, True),
    ("CONTRACT_BODY", rf"^({_ARTICLE})(.+)", " ", 13, True),
    ("ATTACHMENT", r"^(附件\p{Nd}+)[：:](.+)", "：", 14, False),
    ("BID_INSTRUCTIONS", rf"^({_ARTICLE}|[一二三四五六七八九十]+[、.])(.+)", " ", 12, False),
)


def title(doc_type: Column, text: Column, font_size: Column) -> Column:
    """The section title that a block is for its type of document, null for other blocks."""
    line, out = T.normalize_heading(text), F.lit(None).cast("string")
    for kind, pattern, between, least, checked in TITLE_RULES:
        rest = F.regexp_extract(line, pattern, 2)
        if kind == "CONTRACT_BODY":
            rest = F.regexp_replace(rest, r"[.…·]+\p{Nd}*$", "")
        fits = (doc_type == kind) & line.rlike(pattern) & (font_size >= least)
        if checked:
            fits &= ~T.toc_like(text)
        out = F.when(fits, F.concat(F.regexp_extract(line, pattern, 1), F.lit(between), rest)).otherwise(out)
    return out


def priority(doc_type: Column, category: Column) -> Column:
    """(priority, relevance) of a section; a null type is like one without a rule."""
    def pair(name: str, weight: float) -> Column:
        return F.struct(F.lit(name).alias("priority"), F.lit(weight).alias("relevance"))

    attached = doc_type == "ATTACHMENT"
    return (
        F.when(doc_type.isin(*EXCLUDED_TYPES), pair("EXCLUDED", 0.05)).when(doc_type == "REQUIREMENT_SPECIFICATION", pair("PRIMARY", 0.95)).when(doc_type == "CONTRACT_BODY", pair("SECONDARY", 0.6))
        .when(attached & category.isin(*WEIGHTY_IN_ATTACHMENTS), pair("PRIMARY", 0.9)).when(attached, pair("SECONDARY", 0.5)).otherwise(pair("PRIMARY", 0.8))
    )


def item_category(answer: Column, section_category: Column) -> Column:
    """The model's category where it says something, else the section's; names outside the set become UNCLASSIFIED."""
    chosen = F.when(F.coalesce(answer, F.lit("")).isin("", "SCOPE", "UNCLASSIFIED"), section_category).otherwise(answer)
    return F.when(chosen.isin(*CATEGORIES), chosen).otherwise("UNCLASSIFIED")


def asked(content: Column, bad: Column, priority: Column) -> Column:
    """True for sections that a model is asked about: with text, without a bad page, not excluded."""
    return (T.strip(F.coalesce(content, F.lit(""))) != "") & ~bad & (priority != "EXCLUDED")


def final_category(rule: Column, answer: Column) -> Column:
    """The rule's category; the model's (null if not asked) only where no rule matched."""
    return F.when(rule == "UNCLASSIFIED", F.coalesce(answer, rule)).otherwise(rule)


def contents(runs: DataFrame, blocks: DataFrame, scan: int = 8) -> DataFrame:
    """(doc, seq, page, title, printed_page, level) of contents lines.

    ``runs``: doc, seq, start_page, end_page, of which the first pages are
    looked at; ``blocks``: doc, page, ord, text.  Only pages with a contents
    heading count; the heading itself isn't an entry.
    """
    from leafweave.operators.intervals import pages_of

    headed = blocks.where(T.toc_heading(F.col("text"))).select("doc", "page").distinct()
    pages = pages_of(runs, at_most=scan).select("doc", "seq", "page").join(headed, ["doc", "page"], "left_semi")
    rows = pages.join(blocks, ["doc", "page"]).select("doc", "seq", "page", T.toc_entry(F.col("text")).alias("e")).where("e is not null")
    return rows.select("doc", "seq", "page", "e.title", F.col("e.page").alias("printed_page"), "e.level")


def content_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that are neither running lines, page numbers nor excluded; null roles and flags count as content."""
    return blocks.where(~F.coalesce(F.col("role"), F.lit("")).isin(*NOT_CONTENT) & ~F.coalesce("exclude", F.lit(False)))


def relation_prompts(items: DataFrame, most: int = 50, chars: int = 100) -> DataFrame:
    """Items (section, ord, item_id, description) to a prompt for each section with two items or more.

    The prompt lists the first ``most`` items only, as it is the model's input.
    Ranks are cut before the lines are collected, so no list grows with a section.
    """
    from pyspark.sql import Window

    ranked = items.withColumn("k", F.row_number().over(Window.partitionBy("section").orderBy("ord", "item_id"))).where(F.col("k") <= most)
    line = F.concat(F.lit("- "), F.col("item_id").cast("string"), F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, chars))
    listed = ranked.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("l")).where(F.size("l") > 1)
    return listed.select("section", F.array_join("l.line", "\n").alias("prompt"))
