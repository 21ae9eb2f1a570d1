"""Trees of work packages: nodes with a parent, items attached to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded(x: Column, width: int) -> Column:
    """Right-padded to a width; longer text stays whole."""
    return F.rpad(x, F.greatest(F.length(x), F.lit(width)), F.lit(" "))


def indented(title: Column, depth: Column, blank: str = "  ") -> Column:
    return F.concat(F.repeat(F.lit(blank), depth), title)


def page_list(pages: Column, most: int = 5) -> Column:
    """The first ``most`` of the sorted, distinct pages, counted from 1 and comma-joined."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct(pages)), 1, most), lambda p: p + 1), ",")


def preserve(merged: DataFrame, before: DataFrame, key: str = "node") -> DataFrame:
    """The merged nodes and those before (kept by hand or locked) whose id was not made again."""
    return merged.unionByName(before.join(merged.select(key), key, "left_anti"))


def rule_tree(items: DataFrame, most: int = 20) -> DataFrame:
    """Items (section, item) to a level-2 node for each section and a level-3 node for each of its first items."""
    w = Window.partitionBy("section").orderBy("item")
    three = items.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("section", F.lit(3).cast("long").alias("level"), F.col("item").alias("ref"), F.lit(1).cast("long").alias("n_items"))
    two = items.groupBy("section").agg(F.count("*").alias("n_items")).select("section", F.lit(2).cast("long").alias("level"), F.col("section").alias("ref"), "n_items")
    return two.unionByName(three)


def numbered(rows: DataFrame, group: str, order: list[str], template: str) -> Column:
    """Sequential ids within a group, in the given order, as a column for ``rows``."""
    return F.format_string(template, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def paths(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(doc, node, code, depth, above) of a forest (doc, node, parent, ord) of any depth.

    ``code`` joins the places among siblings from the root down, ``above`` has
    the node itself and all its ancestors.  A null, empty or unknown parent
    makes a root.  Every round doubles how far up a node has looked, so the
    rounds are the logarithm of the depth, each a join on the node.  A cycle
    raises ValueError.
    """
    known = nodes.select("doc", F.col("node").alias("up"))
    rows = nodes.select("doc", "node", "ord", F.when(F.col("parent") != "", F.col("parent")).alias("up")).join(known.withColumn("known", F.lit(True)), ["doc", "up"], "left")
    rows = rows.withColumn("up", F.when(F.col("known"), F.col("up")))
    place = F.row_number().over(Window.partitionBy("doc", "up").orderBy("ord", "node"))
    rows = rows.select("doc", "node", "up", place.cast("string").alias("code"), F.array("node").alias("above"))
    for _ in range(most_rounds):
        rows = rows.persist()  # read twice a round; lost blocks are computed again
        if not rows.where("up is not null").limit(1).count():
            return rows.select("doc", "node", "code", F.size("above").cast("long").alias("depth"), "above")
        over = rows.select("doc", F.col("node").alias("up"), F.col("up").alias("further"), F.col("code").alias("head"), F.col("above").alias("more"))
        rows = rows.join(over, ["doc", "up"], "left").select("doc", "node", F.col("further").alias("up"), F.concat_ws(".", "head", "code").alias("code"), F.concat("above", F.coalesce("more", F.array().cast(rows.schema["above"].dataType))).alias("above"))
    raise ValueError("the nodes' parents form a cycle")


def subtree_counts(found: DataFrame, items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items (doc, node, ...) of each node of ``paths`` and all below it, by more columns if given; zero only without them."""
    per = items.groupBy("doc", "node", *(by or [])).agg(F.count("*").alias("n"))
    up = found.join(per, ["doc", "node"]).select("doc", F.explode("above").alias("node"), *(by or []), "n")
    total = up.groupBy("doc", "node", *(by or [])).agg(F.sum("n").alias("n_items"))
    return total if by else found.select("doc", "node").join(total, ["doc", "node"], "left").fillna(0, ["n_items"])


def merged(local: DataFrame, kept: DataFrame, root: str = "wbs-root") -> DataFrame:
    """Local trees (doc, node, parent, ord, title) under one root a document, with codes, then kept nodes (doc, node, parent, title, code).

    The root's code is 0.  A kept node, made by hand or locked, keeps its code;
    it goes if its id was made again.  ``origin`` is merged or kept.
    """
    found = paths(local).select("doc", "node", "code", "depth")
    top = local.select("doc").distinct().select("doc", F.lit(root).alias("node"), F.lit("").alias("parent"), F.lit(0).cast("long").alias("level"), F.lit("WBS Root").alias("title"), F.lit("0").alias("code"))
    own = local.join(found, ["doc", "node"]).select("doc", "node", F.when(F.col("depth") == 1, root).otherwise(F.col("parent")).alias("parent"), F.col("depth").alias("level"), "title", "code")
    new = top.unionByName(own).withColumn("origin", F.lit("merged"))
    old = kept.join(new.select("doc", "node"), ["doc", "node"], "left_anti").select("doc", "node", "parent", F.lit(None).cast("long").alias("level"), "title", "code", F.lit("kept").alias("origin"))
    return new.unionByName(old)
