"""Near-duplicates by the Jaccard similarity of word shingles.

SimHash alone can't find pairs at similarity 0.8: about 10 of their 64 bits
differ, and a radius that covers this leaves no selective blocks.  So two
searches name candidates: equal bands of min-hashes (a pair at 0.8 shares one
of BANDS bands of ROWS values with chance 1 - (1 - 0.8**5)**16 = 0.998) and
SimHash's shards.  Documents that candidates connect form a group, which one
task reads; there a candidate pair counts only if its exact similarity is
large enough.  Equal shingle sets are one node, and a pair that is already
connected isn't compared again, so a group of n alike takes about n
comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm import anchors, graph, simhash, workdir
from leafweave.llm import textkit as tk

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 5

_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * tk.U64(2) + tk.U64(1)
_SALTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row with fewer words has one shingle, a row without a word none."""
    words, before, *_ = anchors.symbols("word", _LOWER[data], offsets)
    out, grams = [], words.fixed(shingle)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(words.hash(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(own: np.ndarray) -> int:
    """A 64-bit hash of a shingle set."""
    h = tk.mix(own ^ tk.U64(0x5851F42D4C957F2D))
    return int(tk.mix(np.array([h.sum(dtype=np.uint64)]) + tk.U64(len(own)))[0])


def bands(own: np.ndarray) -> np.ndarray:
    """The BANDS band keys of a shingle set that isn't empty."""
    least = np.empty(BANDS * ROWS, dtype=np.uint64)
    for k in range(BANDS * ROWS):
        x = (own ^ _SALTS[k]) * _FACTORS[k]
        least[k] = (x ^ (x >> tk.U64(32))).min()
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = tk.mix(key * tk.U64(5) + part)
    return key


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    if not len(one):
        return float(len(two) == 0)
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    both = int((two[at] == one).sum())
    return both / (len(one) + len(two) - both)


class _Joined:
    """Which of some numbers are connected; ``first`` is the least of a connected set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def first(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.first(i), self.first(j)))
        self.up[b] = a


def connected(sets: list[np.ndarray], prints: list[int], least: float = SIMILARITY, radius: int = simhash.RADIUS) -> list[int]:
    """For each set, the first set that candidate pairs of at least that similarity connect it to.

    A bucket holds its members by what they are connected to, so a set is
    compared with members of other connected sets only, until one is alike.
    """
    joined = _Joined(len(sets))

    def meet(i: int, bucket: dict[int, list[int]], failed: set[int]) -> None:
        for r in list(bucket):
            if (now := joined.first(r)) != r:  # has grown together with another
                bucket.setdefault(now, []).extend(bucket.pop(r))
        for members in [m for r, m in bucket.items() if r != joined.first(i)]:
            for j in members:
                if j not in failed:
                    a, b = sorted((len(sets[i]), len(sets[j])))
                    if a >= least * b and similarity(sets[i], sets[j]) >= least:
                        joined.join(i, j)
                        break
                    failed.add(j)

    buckets: dict[tuple[int, int], dict[int, list[int]]] = {}
    trees: dict[int, tuple[simhash.BKTree, list[list[int]]]] = {}  # one for each connected set
    for i, own in enumerate(sets):
        failed: set[int] = set()
        for place in enumerate(bands(own).tolist() if len(own) else ()):
            bucket = buckets.setdefault(place, {})
            meet(i, bucket, failed)
            bucket.setdefault(joined.first(i), []).append(i)
        for r, (tree, members) in trees.items():
            if joined.first(r) != joined.first(i):
                near = {r: [j for node in tree.within(prints[i], radius) for j in members[node]]}
                meet(i, near, failed)
        mine = [r for r in trees if joined.first(r) == joined.first(i)]
        parts = sorted((trees.pop(r) for r in mine), key=lambda t: -len(t[1])) or [(simhash.BKTree(), [])]
        tree, members = parts[0]
        for other, held in parts[1:]:
            for value in other.values:
                tree.insert(value)
            members += held
        tree.insert(prints[i])
        members.append([i])
        trees[joined.first(i)] = (tree, members)
    return [joined.first(i) for i in range(len(sets))]


def _described(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, set_key, fp and the bands (null without a word) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.flat(batch.column(1))
            for lo, hi in tk.slices(offsets):
                own, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                sets = shingles(own, offs, shingle)
                fp = np.array([simhash.fingerprint(own[a:b].tobytes(), shingle) for a, b in zip(offs[:-1], offs[1:], strict=True)], dtype=np.uint64)
                keys = np.array([set_key(s) for s in sets], dtype=np.uint64)
                band = pa.array([bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64)), band], ["doc_id", "set_key", "fp", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, set_key long, fp long, bands array<long>")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the smallest id reachable by pairs of at least that similarity.

    Texts without a word, null ones included, are equal.  Rows with a null id
    have the component of the ids with the same shingles, if any, and connect
    nothing.  Repeated rows are alike; an empty table gives an empty result.
    """
    described = workdir.cut(_described(docs, shingle, id_col, text_col))
    nodes = workdir.cut(described.groupBy("set_key").agg(F.min("doc_id").alias("label"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).where("label is not null"))
    # ids may repeat with different texts, so nodes are told apart by their sets
    keyed = nodes.select(F.posexplode("bands").alias("place", "band"), "set_key")
    first = keyed.groupBy("place", "band").agg(F.min("set_key").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keyed.join(first, ["place", "band"]).where("set_key <> b").select(F.col("set_key").alias("a"), "b")
    prints = workdir.cut(nodes.groupBy("fp").agg(F.min("set_key").alias("label")))
    pairs = pairs.unionByName(nodes.select("set_key", "fp").join(prints, "fp").where("set_key <> label").select(F.col("set_key").alias("a"), F.col("label").alias("b")))
    pairs = pairs.unionByName(simhash.shard_links(prints, prints.count()))
    grouped = graph.components(pairs)
    wanted = workdir.cut(nodes.join(grouped, nodes.set_key == grouped.node).select("set_key", "label", "root"))
    texts = docs.select(F.col(id_col).cast("long").alias("label"), F.col(text_col).alias("text")).join(wanted, "label").select("root", "label", "set_key", "text")
    texts = texts.repartition(workdir.partitions(docs), "root").sortWithinPartitions("root", "label", "set_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, keys, ids, sets, prints = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                to = connected(sets, prints, least)
                best: dict[int, int] = {}
                for i, r in enumerate(to):
                    best[r] = min(best.get(r, ids[i]), ids[i])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([best[r] for r in to], pa.int64())], ["set_key", "component_id"])

        for batch in batches:
            data, offsets = tk.flat(batch.column(3))
            for i, (group, label, key) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if group != root:
                    yield from done()
                    root, keys, ids, sets, prints = group, [], [], [], []
                if keys and keys[-1] == key:
                    continue
                text = data[offsets[i] : offsets[i + 1]]
                own = shingles(text, np.array([0, len(text)]), shingle)[0]
                if int(np.array([set_key(own)], dtype=np.uint64).view(np.int64)[0]) == key:
                    keys.append(key)
                    ids.append(label)
                    sets.append(own)
                    prints.append(simhash.fingerprint(text.tobytes(), shingle))
        yield from done()

    named = texts.mapInArrow(run, "set_key long, component_id long")
    named = nodes.select("set_key", "label").join(named, "set_key", "left").select("set_key", F.coalesce("component_id", "label").alias("component_id"))
    # written first, so that both sides of the join are plain exchanges, of which Spark splits large partitions
    return described.select("doc_id", "set_key").join(workdir.cut(named), "set_key", "left").select("doc_id", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; rows with a null id stay."""
    other = near_duplicates(docs, shingle, least, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(other, id_col, "left_anti").select(docs.columns)
