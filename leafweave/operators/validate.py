"""What is to be said about a tree of work packages and the pages behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issues(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(category, severity, message, node, needs_review).

    ``nodes``: node, code, level, parent, type, source_pages, work_items;
    ``pages``: quality.  Nodes below the root need a code and a parent, and
    explicit ones from level 2 on source pages.  Pages that couldn't be read
    and leaves without items give one issue each.
    """
    def rows(of: DataFrame, category: str, severity: str, message, node=None, review: bool = False) -> DataFrame:
        return of.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message"), (F.lit("") if node is None else node).alias("node"), F.lit(review).alias("needs_review"))

    node, below = F.col("node"), nodes.where("level > 0")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    said = lambda head, tail: F.concat(F.lit(head), node, F.lit(tail))
    none = F.coalesce(F.size("source_pages"), F.lit(0)) <= 0
    counted = pages.agg(F.count_if(F.col("quality") == "GARBLED_TEXT").alias("garbled"), F.count_if(F.col("quality") == "IMAGE_ONLY").alias("scanned"))
    leaves = below.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    empty = leaves.where(F.coalesce(F.size("work_items"), F.lit(0)) <= 0).agg(F.count("*").alias("n"))
    number = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    # Categories, severities and messages.
    found = (
        rows(below.where(blank("code")), "structure", "warning", said("Node ", " has no WBS code"), node),
        rows(below.where(blank("parent")), "structure", "warning", said("Node ", " has no parent"), node),
        rows(nodes.where((F.col("type") == "EXPLICIT") & (F.col("level") > 1) & none), "source", "info", said("EXPLICIT node ", " has no source pages"), node),
        rows(counted.where("garbled > 0"), "coverage", "warning", number("garbled", " garbled pages not analyzed"), review=True),
        rows(counted.where("scanned > 0"), "coverage", "info", number("scanned", " scanned pages not analyzed")),
        rows(empty.where("n > 0"), "semantic", "info", number("n", " leaf nodes have no work items")),
    )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def report(found: DataFrame) -> DataFrame:
    """(issues, needs_review, passed): passed unless an issue is an error."""
    return found.agg(F.count("*").alias("issues"), F.count_if("needs_review").alias("needs_review"), (F.count_if(F.col("severity") == "error") == 0).alias("passed"))
