"""Page quality: first pass, neighbour resolution, summary."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOK = 5


def first_pass(pages: DataFrame) -> DataFrame:
    """Adds state from char_count, cjk_count, image_count."""
    state = F.when(F.col("char_count") == 0, F.when(F.col("image_count") > 0, "IMAGE_ONLY").otherwise("EMPTY")).when(F.col("cjk_count") > 0, "NORMAL_TEXT").otherwise("GARBLED_TEXT")
    return pages.withColumn("state", state)


def resolve(states: DataFrame) -> DataFrame:
    """(doc, page, before, after) for (doc, page, c) with c in N, G, E, I: settles E and I by their neighbours.

    A page sees the next definite page as given and the previous one as already
    settled.  Documents are dealt once and read in page order; of the pages
    before, only the last LOOK settled ones are held, so a document may have
    any number of pages.
    """
    dealt = states.select("doc", "page", "c").repartition("doc")
    ahead = Window.partitionBy("doc").orderBy("page").rowsBetween(1, LOOK)
    nx = F.first(F.when(F.col("c").isin("N", "G"), F.col("c")), ignorenulls=True).over(ahead)
    pages = dealt.select("doc", "page", "c", nx.alias("nx")).sortWithinPartitions("doc", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, recent = None, deque(maxlen=LOOK)
        for batch in batches:
            settled = []
            for doc, c, nxt in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if doc != here:
                    here = doc
                    recent.clear()
                if c in ("E", "I"):
                    sides = {s for s in (next((x for x in reversed(recent) if x in ("N", "G")), None), nxt) if s}
                    if c == "E":
                        c = "G" if sides == {"G"} else "N"
                    elif "G" in sides:
                        c = "G"
                recent.append(c)
                settled.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(settled, pa.string())], ["doc", "page", "before", "after"])

    return pages.mapInArrow(run, "doc string, page long, before string, after string")


def summary(resolved: DataFrame, by: str | None = None) -> DataFrame:
    counts = [F.count("*").alias("total_pages"), *[F.count_if(F.col("after") == c).cast("long").alias(n) for c, n in (("N", "normal"), ("G", "garbled"), ("I", "image_only"), ("E", "empty"))]]
    return resolved.groupBy(by).agg(*counts) if by else resolved.agg(*counts)
