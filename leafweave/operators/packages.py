"""Local trees of work packages from a model's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafweave.functions import text as T


def from_nodes(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc, subdoc, node, title, level, parent, work_items, type) of all trees.

    ``nodes``: doc, subdoc, pos, title, children (titles), work_items;
    ``titles``: doc, subdoc, title.  A subdocument's root is level 1.  A node
    titled like a child of any node is put off: its items go to the last
    level-3 node of that title, or it becomes a level-2 node at the end if no
    parent made one.  Other nodes are level 2, their children level 3.  Node
    numbers count through a document in this order.
    """
    key, names = ["doc", "subdoc"], T.strip(F.coalesce(F.col("title"), F.lit("")))
    children = F.filter(F.transform(F.coalesce("children", F.array().cast("array<string>")), T.strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    rows = nodes.select(*key, F.col("pos").cast("long").alias("pos"), names.alias("title"), children.alias("children"), F.coalesce(F.col("work_items").cast("array<string>"), none).alias("items"))
    listed = rows.select(*key, F.explode("children").alias("title")).distinct().withColumn("listed", F.lit(True))
    rows = rows.join(listed, [*key, "title"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    kept, put_off = rows.where("not listed"), rows.where("listed")
    order = lambda stage, pos, child: F.struct(F.lit(stage).alias("stage"), pos.alias("pos"), child.cast("long").alias("child")).alias("at")
    two = kept.select(*key, order(1, F.col("pos"), F.lit(-1)), "title", F.lit(2).alias("level"), "items")
    three = kept.select(*key, "pos", F.posexplode("children").alias("child", "title")).select(*key, order(1, F.col("pos"), F.col("child")), "title")
    target = three.groupBy(*key, "title").agg(F.max("at").alias("target"))
    sent = put_off.join(target, [*key, "title"], "left")
    # array_sort: items in the order of the nodes that bring them
    brought = sent.where("target is not null").groupBy(*key, F.col("target").alias("at")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "items"))), lambda x: x["items"])).alias("items"))
    three = three.join(brought, [*key, "at"], "left").select(*key, "at", "title", F.lit(3).alias("level"), F.coalesce("items", none).alias("items"))
    late = sent.where("target is null").select(*key, order(2, F.col("pos"), F.lit(-1)), "title", F.lit(2).alias("level"), "items")
    root = titles.join(rows.select(*key).distinct(), key, "left_semi").select(*key, order(0, F.lit(-1).cast("long"), F.lit(-1)), F.coalesce("title", F.col("subdoc").cast("string")).alias("title"), F.lit(1).alias("level"), none.alias("items"))
    every = root.unionByName(two).unionByName(three).unionByName(late)
    number = F.row_number().over(Window.partitionBy("doc").orderBy("subdoc", "at"))
    numbered = every.withColumn("node", F.concat(F.lit("wbs-"), number))
    within = Window.partitionBy("doc").orderBy("subdoc", "at").rowsBetween(Window.unboundedPreceding, 0)

    def above(level: int):
        return F.last(F.when(F.col("level") == level, F.col("node")), ignorenulls=True).over(within)

    parent = F.when(F.col("level") == 1, "").when(F.col("level") == 2, above(1)).otherwise(above(2))
    kind = F.when(F.col("level") == 1, "EXPLICIT").otherwise("INFERRED")
    return numbered.select(*key, "node", "title", F.col("level").cast("long").alias("level"), parent.alias("parent"), F.col("items").alias("work_items"), kind.alias("type"))


def usable(nodes: DataFrame) -> DataFrame:
    """Nodes of subdocuments whose answer isn't the stand-in's, that is not all titles begin with mock_."""
    real = nodes.groupBy("doc", "subdoc").agg(F.max(~F.coalesce("title", F.lit("")).startswith("mock_")).alias("real")).where("real")
    return nodes.join(real.select("doc", "subdoc"), ["doc", "subdoc"], "left_semi")
