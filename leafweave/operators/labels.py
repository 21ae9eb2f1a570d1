"""Which kind of subdocument each page belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafweave.functions import text as T

# Labels with their titles, the words that mark a zone, anchors and how many of a page's blocks they may stand in.
TITLES = {
    "CONTRACT_BODY": "契約本文", "ATTACHMENT": "附件", "SIGNATURE_PAGE": "簽署頁", "REQUIREMENT_SPECIFICATION": "需求規範書", "BID_INSTRUCTIONS": "投標須知",
    "EVALUATION_GUIDELINES": "評選須知", "TENDER_ANNOUNCEMENT": "招標公告", "SCANNED_PAGES": "掃描頁", "LAW_OR_POLICY": "法規文件", "SERVICE_PROPOSAL": "服務建議書",
}
BID_WORDS = ("投標", "須知")
DATE_PATTERN = "{n}/{n}/{n}"
IGNORED_PATTERN = "{n}"
ATTACHMENT_HEAD, ATTACHMENT_SIZE, ATTACHMENT_BLOCKS = r"^附件[\p{Nd}一二三四五六七八九十]", 14, 4
SIGNATURE_HEAD, SIGNATURE_BLOCKS = "^立契約人", 4
TENDER_WORDS, TENDER_BLOCKS = "招標公告|公開評選|公開徵求", 6


def bid_pattern(pattern: Column) -> Column:
    return pattern.contains(BID_WORDS[0]) | pattern.contains(BID_WORDS[1])


def date_pattern(pattern: Column) -> Column:
    return pattern.contains(DATE_PATTERN)


def ignored_pattern(pattern: Column) -> Column:
    return T.strip(pattern) == IGNORED_PATTERN


def _zones(families: DataFrame) -> DataFrame:
    """(doc, page, bid, evaluation): pages of the zone families.

    The last family that matches is the document's, footers scanned before
    headers.  A page with several families of a role counts under the last.
    """
    rows = families.where(~ignored_pattern(F.col("pattern"))).withColumn("scan", F.struct((F.col("role") == "RUNNING_HEADER").cast("int").alias("late"), "family"))
    last = rows.groupBy("doc").agg(F.max(F.when(bid_pattern(F.col("pattern")), F.col("scan"))).alias("bid_scan"), F.max(F.when(date_pattern(F.col("pattern")), F.col("scan"))).alias("date_scan"))

    def of(role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("scan")))

    pages = rows.groupBy("doc", "page").agg(of("RUNNING_FOOTER").alias("footer"), of("RUNNING_HEADER").alias("header"))
    return pages.join(last, "doc").select("doc", "page", F.coalesce(F.col("footer") == F.col("bid_scan"), F.lit(False)).alias("bid"), F.coalesce(F.col("header") == F.col("date_scan"), F.lit(False)).alias("evaluation"))


def _signs(blocks: DataFrame) -> DataFrame:
    """(doc, page, boxes, attachment, signature, tender): what a page's blocks show."""
    flat, n = T.normalize_heading(F.col("text")), F.col("ord")
    attachment = (n < ATTACHMENT_BLOCKS) & flat.rlike(ATTACHMENT_HEAD) & (F.col("font_size") >= ATTACHMENT_SIZE) & ~T.toc_like(F.col("text"))
    signature, tender = (n < SIGNATURE_BLOCKS) & flat.rlike(SIGNATURE_HEAD), (n < TENDER_BLOCKS) & flat.rlike(TENDER_WORDS)
    return blocks.groupBy("doc", "page").agg(*[F.max(F.coalesce(x, F.lit(False))).alias(k) for k, x in (("boxes", T.boxed(F.col("text"))), ("attachment", attachment), ("signature", signature), ("tender", tender))])


def page_labels(pages: DataFrame, blocks: DataFrame, families: DataFrame) -> DataFrame:
    """Adds label to pages (doc, page, quality).

    ``blocks``: doc, page, ord (its place on the page), text, font_size.
    ``families``: doc, family (in list order), role, pattern, page, a row for
    each page with a block of the family.  Labels are laid over each other in
    a fixed order; each step sees what the ones before it left.  Every window
    is over a document, so all steps share one exchange.
    """
    doc = Window.partitionBy("doc")
    rows = pages.join(_zones(families), ["doc", "page"], "left").join(_signs(blocks), ["doc", "page"], "left")
    rows = rows.fillna(False, ["bid", "evaluation", "boxes", "attachment", "signature", "tender"])
    page, label, free = F.col("page"), F.col("label"), F.col("label").isNull()

    def first(cond: Column) -> Column:
        return F.min(F.when(cond, page)).over(doc)

    def fill(rows: DataFrame, cond: Column, name: str) -> DataFrame:
        return rows.withColumn("label", F.when(free & F.coalesce(cond, F.lit(False)), name).otherwise(label))

    rows = rows.withColumn("label", F.when(F.col("evaluation"), "EVALUATION_GUIDELINES").when(F.col("bid"), "BID_INSTRUCTIONS").when(F.col("quality") == "IMAGE_ONLY", "SCANNED_PAGES").when(F.col("quality") == "GARBLED_TEXT", "SERVICE_PROPOSAL"))
    normal = F.coalesce(F.col("quality") == "NORMAL_TEXT", F.lit(False))
    rows = fill(rows, normal & F.col("boxes"), "LAW_OR_POLICY")
    open_ = free & normal
    rows = rows.select(
        "*", first(open_ & F.col("attachment")).alias("_attachment"), first(open_ & F.col("signature")).alias("_signature"), first(open_ & F.col("tender")).alias("_tender"),
        first(F.col("bid")).alias("_bid"), F.max(F.when(F.col("bid"), page)).over(doc).alias("_last_bid"), first(F.col("evaluation")).alias("_eval"), F.max(F.when(F.col("evaluation"), page)).over(doc).alias("_last_eval"),
    )
    behind = rows.withColumn("_stop", first(~free & (page > F.col("_tender"))))
    rows = fill(behind, (page >= F.col("_tender")) & (F.col("_stop").isNull() | (page < F.col("_stop"))), "TENDER_ANNOUNCEMENT")
    rows = fill(rows, (page > F.col("_last_bid")) & (page < F.col("_eval")), "EVALUATION_GUIDELINES")
    behind = rows.withColumn("_stop", first(~free & (page > F.col("_last_eval"))))
    rows = fill(behind, (page > F.col("_last_eval")) & (F.col("_stop").isNull() | (page < F.col("_stop"))), "EVALUATION_GUIDELINES")
    rows = fill(rows, (page > F.col("_signature")) & (page < F.col("_bid")), "REQUIREMENT_SPECIFICATION")
    end = F.coalesce("_signature", "_bid")
    rows = fill(rows, (page >= F.col("_attachment")) & (end.isNull() | (page < end)), "ATTACHMENT")
    rows = rows.withColumn("label", F.when(F.col("page") == F.col("_signature"), "SIGNATURE_PAGE").otherwise(label))
    onward = doc.orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*pages.columns, F.coalesce(F.last("label", ignorenulls=True).over(onward), F.lit("CONTRACT_BODY")).alias("label"))


def gap_fill(pages: DataFrame, before: str, after: str, name: str) -> DataFrame:
    """Pages (doc, page, label) with null labels between the last page of one label and the first of another filled."""
    doc = Window.partitionBy("doc")
    lo, hi = F.max(F.when(F.col("label") == before, F.col("page"))).over(doc), F.min(F.when(F.col("label") == after, F.col("page"))).over(doc)
    inside = F.coalesce(F.col("label").isNull() & (F.col("page") > lo) & (F.col("page") < hi), F.lit(False))
    return pages.withColumn("label", F.when(inside, name).otherwise(F.col("label")))


def titled(segments: DataFrame) -> DataFrame:
    """Adds doc_type and title to segments (label): an unknown label is its own title."""
    known = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    title = F.element_at(known, F.col("label"))
    return segments.withColumn("doc_type", F.when(title.isNull(), "UNKNOWN").otherwise(F.col("label"))).withColumn("title", F.coalesce(title, "label"))
