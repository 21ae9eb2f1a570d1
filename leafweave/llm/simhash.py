"""SimHash near-duplicates, searched with BK-trees.

Documents with equal fingerprints are one node.  Two fingerprints that differ
in at most r of 64 bits agree in at least b - r of b blocks of bits, so each
node goes to one shard for every choice of b - r blocks, named by their bits.
A shard's task builds a BK-tree (children keyed by their distance to the
parent) and looks up each node while it inserts it, following only edges
within the radius.  Its links join what isn't joined yet, so a shard of n
nodes gives fewer than n links, and none that matters is lost.

b grows with the number of fingerprints until shards are small.  A shard tree
stays in the task that holds the shard: all fingerprints together grow with
the corpus, so no tree is sent to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import graph, workdir
from leafweave.llm import textkit as tk

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Nodes of a shard's tree; a larger shard is split by more blocks, as far as there are bits.
TREE_NODES = 2000
#: b: the number of fingerprints from which the next larger is used.
BLOCKS = ((6, 60_000_000), (7, 4_000_000_000), (8, 1 << 62))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a lower-cased text's word shingles; 0 if it has no word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - shingle + 1)
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, 50_000):
        part = np.array([digest(flat[a:b], seed) for a, b in zip(starts[lo : min(n, lo + 50_000)], stops[lo : lo + 50_000], strict=False)], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.flat(batch.column(1))
            fp = np.array([fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.children: list[dict[int, int]] = []
        self.values: list[int] = []

    def insert(self, value: int) -> int:
        """Adds a value, which is its own parent's child at distance 0 if the tree holds it; its number."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (value ^ self.values[at]).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of all values at most ``radius`` away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) > 2 * radius + 1:
                todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
            else:
                todo += [c for k, c in kids.items() if -radius <= k - d <= radius]
        return found


def masks(blocks: int, radius: int, bits: list[int] | None = None) -> list[int]:
    """One mask for every choice of ``blocks - radius`` blocks of the bits."""
    bits = list(range(64)) if bits is None else bits
    cut = np.array_split(np.array(bits), blocks)
    block = [sum(1 << int(i) for i in part) for part in cut]
    return [sum(chosen) for chosen in combinations(block, blocks - radius)]


def links(values: list[int], radius: int = RADIUS, used: int = 0, limit: int = TREE_NODES) -> list[tuple[int, int]]:
    """Links (positions) that join all values of a shard reachable by steps within the radius."""
    free = [i for i in range(64) if not used >> i & 1]
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))

    if len(values) > limit and len(free) >= 4 * (radius + 1):
        for mask in masks(radius + 1, radius, free):
            parts: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                parts.setdefault(v & mask, []).append(i)
            for part in parts.values():
                if 1 < len(part):
                    if len(part) == len(values):  # a block in which all agree splits nothing
                        for i, j in links([values[k] for k in part], radius, used | mask, limit):
                            join(part[i], part[j])
                        return out
                    for i, j in links([values[k] for k in part], radius, used | mask, limit):
                        join(part[i], part[j])
        return out
    tree = BKTree()
    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            join(i, j)
        tree.insert(v)
    return out


def shard_links(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the labels of nodes (fp, label), from all shards."""
    blocks = next(b for b, upto in BLOCKS if count <= upto)
    blocks += radius - RADIUS
    shards = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(masks(blocks, radius))]
    rows = nodes.select("fp", "label", F.explode(F.array(*shards)).alias("s")).select("s.choice", "s.bits", "fp", "label")
    used = masks(blocks, radius)
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(used) * count // 1_000_000)
    rows = rows.repartition(n, "choice", "bits").sortWithinPartitions("choice", "bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple | None = None
        fps: list[int] = []
        labels: list[int] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(fps) > 1 and (pairs := links(fps, radius, used[shard[0]])):
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i in a], pa.int64()), pa.array([labels[i] for i in b], pa.int64())], ["a", "b"])

        for batch in batches:
            choice, bits, fp, label = (np.asarray(batch.column(i)) for i in range(4))
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])
            at = np.append(np.flatnonzero(new), len(fp))
            u, own = fp.view(np.uint64).tolist(), label.tolist()
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                here = (int(choice[lo]), int(bits[lo]))
                if here != shard:
                    yield from done()
                    shard, fps, labels = here, [], []
                fps += u[lo:hi]
                labels += own[lo:hi]
        if shard is not None:
            yield from done()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links reach, a document's own
    included.  Null or empty texts and texts without a word have fingerprint
    zero and link like any other.  Rows with a null id keep their fingerprint
    and have a null component unless their fingerprint links them to an id.
    """
    prints = workdir.cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = workdir.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("label")).where("label is not null"))
    roots = graph.components(shard_links(nodes, nodes.count(), radius))
    named = nodes.join(roots, nodes.label == roots.node, "left").select("fp", F.coalesce("root", "label").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; rows with a null id stay."""
    other = near_duplicates(docs, radius, shingle, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(other, id_col, "left_anti").select(docs.columns)


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near-duplicate classes of the whole table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
