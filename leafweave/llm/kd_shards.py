"""Sharding by a k-d tree over document metadata.

Each node of the tree is split at a weighted median along the dimension in
which it is widest, in proportion to the shards on either side, until every
leaf is a shard.  Weights are bytes, so shards come out near equal in bytes.

A row's place along a dimension is one 63-bit number: the dimension's value,
then a hash of its text, then, for a heavy group of equal texts only, a hash of
its id.  Equal texts share their metadata (the least of the group), so a group
stays whole unless it weighs a fair part of a shard and a cut falls into it.
Medians are found by histograms of that number, 12 bits at a time, for all
nodes of a level at once.  The tree is a few arrays, walked by whole batches of
rows, so it may have any number of shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import workdir

#: A group of equal texts above this share of a shard may be cut.
HEAVY = 0.02
#: Cuts need be no nearer to the median than this share of their node.
EXACT = 0.0005
#: A cut further off than this share of its node has the next widest dimension tried.
NEAR = 0.002
#: Groups of equal texts with at least this part of all rows are broadcast; there can't be more of them.
MANY = 4096
#: Sums that the driver gets at once, at most.
CELLS = 1 << 20
_VALUE, _GROUP, _ROW, _STEP = 20, 26, 17, 12
_BITS = _VALUE + _GROUP + _ROW


@dataclass
class Tree:
    """Nodes as arrays: the shards of a node are shard .. shard + shards - 1; an inner node has dim, cut and its left child, the right one follows it."""

    shard: np.ndarray
    shards: np.ndarray
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    @classmethod
    def root(cls, shards: int) -> Tree:
        one = lambda x: np.array([x], dtype=np.int64)
        return cls(one(0), one(shards), one(0), one(0), one(-1))

    def open(self) -> np.ndarray:
        """Leaves that hold more than one shard."""
        return np.flatnonzero((self.left < 0) & (self.shards > 1))

    def split(self, nodes: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> None:
        half = self.shards[nodes] // 2
        self.dim[nodes], self.cut[nodes] = dims, cuts
        self.left[nodes] = len(self.shard) + 2 * np.arange(len(nodes))
        shard = np.stack([self.shard[nodes], self.shard[nodes] + half], axis=1).ravel()
        shards = np.stack([half, self.shards[nodes] - half], axis=1).ravel()
        none = np.zeros(len(shard), dtype=np.int64)
        self.shard, self.shards = np.concatenate([self.shard, shard]), np.concatenate([self.shards, shards])
        self.dim, self.cut, self.left = np.concatenate([self.dim, none]), np.concatenate([self.cut, none]), np.concatenate([self.left, none - 1])

    def leaf(self, keys: list[np.ndarray]) -> np.ndarray:
        """The leaf of each row, by walking down with all rows at once."""
        table = np.stack(keys) if len(keys[0]) else np.zeros((len(keys), 0), dtype=np.int64)
        at, rows = np.zeros(table.shape[1], dtype=np.int64), np.arange(table.shape[1])
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            right = table[self.dim[at], rows] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)


def _text_number(column: str) -> Column:
    """The first six bytes of a string as a number that sorts alike."""
    padded = F.rpad(F.hex(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 12, "0")
    return F.conv(padded, 16, 10).cast("double")


def keyed(docs: DataFrame, shards: int, id_col: str, text_col: str, dims: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32 and a key for each dimension, materialised; number of dimensions)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    have = [d for d in dims if d in docs.columns]
    numbers = [_text_number(d) if dict(docs.dtypes)[d] == "string" else F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in have]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), *[n.alias(f"d{i + 2}") for i, n in enumerate(numbers)])
    rows = workdir.cut(rows.withColumn("d0", F.log2("size")).withColumn("d1", F.coalesce(F.col("doc_id"), F.lit(0)).cast("double")))
    n = 2 + len(have)
    groups = workdir.cut(rows.groupBy("text_key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), *[F.min(f"d{i}").alias(f"g{i}") for i in range(n)]).where("n > 1"))
    total, count, *ends = rows.agg(F.sum("size"), F.count("*"), *[f(f"d{i}") for i in range(n) for f in (F.min, F.max)]).first()
    # groups with a fair share of the rows, at most MANY, are sent to every task; the rest are too small to make a key hot
    many = F.col("n") >= max(2, (count or 0) / MANY)
    # a row's own values, or the least of its group
    sent = rows.join(F.broadcast(groups.where(many)), "text_key", "left")
    small = groups.where(~many)
    rest = sent.where("n is null").drop(*groups.columns[1:]).join(small, "text_key", "left")
    both = sent.where("n is not null").unionByName(rest)
    weight = F.coalesce("weight", "size")
    heavy = weight > F.lit(HEAVY * (total or 0) / shards)
    tie = (F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(1 << _GROUP)) * (1 << _ROW)) + F.when(heavy, F.pmod(F.xxhash64("doc_id"), F.lit(1 << _ROW))).otherwise(0)
    keys = []
    for i in range(n):
        lo, hi = ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0
        value = F.floor((F.coalesce(f"g{i}", f"d{i}") - lo) * (((1 << _VALUE) - 1) / (hi - lo if hi > lo else 1.0)))
        keys.append((value * (1 << (_GROUP + _ROW)) + tie).cast("long").alias(f"k{i}"))
    return workdir.cut(both.select("doc_id", "size", "text_crc32", *keys)), n


def _keys(batch: pa.RecordBatch, n_dims: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(f"k{i}")) for i in range(n_dims)]


def grow(rows: DataFrame, n_dims: int, shards: int) -> Tree:
    """The tree; every level is a few aggregations over all rows, of sums that each task has made of its own."""
    tree = Tree.root(shards)
    span = None
    while len(nodes := tree.open()):
        stats = _stats(rows, tree, n_dims)
        if span is None:
            span = [max(1, stats[0][1][i]) if 0 in stats else 1 for i in range(n_dims)]
        weight = np.array([stats[x][0] if x in stats else 0 for x in nodes.tolist()], dtype=np.int64)
        widths = [sorted(range(n_dims), key=lambda d, x=x: (-stats[x][1][d] / span[d], d)) if x in stats else [0] for x in nodes.tolist()]
        best_miss, best_dim, best_cut = np.full(len(nodes), np.inf), np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        # the widest dimension, unless a large row sits at its median and another one's cut is nearer
        for k in range(n_dims):
            again = np.array([i for i in range(len(nodes)) if best_miss[i] > NEAR * weight[i] and k < len(widths[i])], dtype=np.int64)
            if not len(again):
                break
            dims = np.array([widths[i][k] for i in again], dtype=np.int64)
            miss, cut = _medians(rows, tree, n_dims, nodes[again], dims, weight[again])
            nearer = miss < best_miss[again]
            at = again[nearer]
            best_miss[at], best_dim[at], best_cut[at] = miss[nearer], dims[nearer], cut[nearer]
        tree.split(nodes, best_dim, best_cut)
    return tree


def _stats(rows: DataFrame, tree: Tree, n_dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each open leaf: its weight, and how wide it is in each dimension."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    names = [f"{f}{i}" for i in range(n_dims) for f in ("lo", "hi")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            keys = _keys(batch, n_dims)
            node, inverse = np.unique(t.leaf(keys), return_inverse=True)
            weight = np.bincount(inverse, weights=np.asarray(batch.column("size")), minlength=len(node)).astype(np.int64)
            ends = []
            for key in keys:
                value = key >> (_GROUP + _ROW)
                lo, hi = np.full(len(node), np.iinfo(np.int64).max), np.full(len(node), np.iinfo(np.int64).min)
                np.minimum.at(lo, inverse, value)
                np.maximum.at(hi, inverse, value)
                ends += [pa.array(lo), pa.array(hi)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(weight), *ends], ["node", "w", *names])

    made = rows.mapInArrow(run, "node long, w long, " + ", ".join(f"{x} long" for x in names))
    open_ = set(tree.open().tolist())
    total = made.groupBy("node").agg(F.sum("w").alias("w"), *[(F.max(f"hi{i}") - F.min(f"lo{i}")).alias(f"s{i}") for i in range(n_dims)])
    return {r["node"]: (r["w"], [r[f"s{i}"] for i in range(n_dims)]) for r in total.collect() if r["node"] in open_}


def _medians(rows: DataFrame, tree: Tree, n_dims: int, nodes: np.ndarray, dims: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes by which each node's cut misses its share, the cut), by ever finer histograms of the keys around it.

    The driver gets at most CELLS sums a round, whatever the number of nodes.
    """
    half = tree.shards[nodes] // 2
    want = weight * half / tree.shards[nodes]
    below, prefix = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    miss, cut, done = np.full(len(nodes), np.inf), np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=bool)
    left = _BITS
    while left > 0 and not done.all():
        todo = np.flatnonzero(~done)
        step = min(_STEP, left, max(1, int(math.log2(CELLS / len(todo)))))
        number = np.full(len(tree.shard), -1, dtype=np.int64)
        number[nodes[todo]] = todo
        shared = rows.sparkSession.sparkContext.broadcast((tree, number, dims, prefix.copy(), left, step))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t, number, dims, prefix, left, step = shared.value
            for batch in batches:
                keys = _keys(batch, n_dims)
                which = number[t.leaf(keys)]
                at = np.flatnonzero(which >= 0)
                key = np.stack(keys)[dims[which[at]], at] if len(at) else np.zeros(0, dtype=np.int64)
                inside = (key >> left) == prefix[which[at]] if left < _BITS else np.ones(len(at), dtype=bool)
                at, key = at[inside], key[inside]
                cell, inverse = np.unique(np.stack([which[at], key >> (left - step)]), axis=1, return_inverse=True)
                w = np.bincount(inverse.ravel(), weights=np.asarray(batch.column("size"))[at], minlength=cell.shape[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell[0]), pa.array(cell[1]), pa.array(w)], ["i", "cell", "w"])

        cells = rows.mapInArrow(run, "i long, cell long, w long").groupBy("i", "cell").agg(F.sum("w").alias("w")).collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for r in cells:
            by.setdefault(r["i"], []).append((r["cell"], r["w"]))
        left -= step
        for i in todo.tolist():
            sums, cell, w = int(below[i]), int(prefix[i]) << step, 0
            for cell, w in sorted(by.get(i, [])):
                if sums + w >= want[i]:
                    break
                sums += w
            under, over = want[i] - sums, sums + w - want[i]
            if min(under, over) <= max(1.0, EXACT * weight[i]) or left == 0:
                # cut before the cell, or behind it
                miss[i], cut[i], done[i] = min(under, over), ((cell << left) if under <= over else ((cell + 1) << left)) - 1, True
            else:
                below[i], prefix[i] = sums, cell
    return miss, cut


def _placed(rows: DataFrame, tree: Tree, n_dims: int) -> DataFrame:
    """doc_id, size, text_crc32, shard."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = shared.value
            shard = t.shard[t.leaf(_keys(batch, n_dims))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard)], ["doc_id", "size", "text_crc32", "shard"])

    return rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Give the number of shards or the bytes that each should have.  A null text
    counts as empty, with size 1.  Null metadata sorts first.  Rows alike get
    different slots of one shard, or of two if their group is cut.  An empty
    table gives an empty result.
    """
    if shards is None:
        total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1)).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    rows, n = keyed(docs, shards, id_col, text_col, dims)
    tree = grow(rows, n, shards)
    placed = _placed(rows, tree, n)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = workdir.cut(placed.repartitionByRange(tasks, "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32"))
    return slots(dealt)


def slots(dealt: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0.

    ``dealt`` is materialised and sorted by shard across and within its
    partitions, so a partition's first slot in a shard is a prefix sum of row
    counts by partition.
    """
    counts = dealt.groupBy(F.spark_partition_id().alias("p"), "shard").agg(F.count("*").alias("n")).collect()
    first: dict[tuple[int, int], int] = {}
    done: dict[int, int] = {}
    for p, s, n in sorted((r["p"], r["shard"], r["n"]) for r in counts):
        first[p, s] = done.get(s, 0)
        done[s] = first[p, s] + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at = {s: n for (p, s), n in first.items() if p == part}
        for batch in batches:
            shard_of = np.asarray(batch.column(3))
            slot = np.zeros(len(shard_of), dtype=np.int64)
            for s in np.unique(shard_of).tolist():
                mine = np.flatnonzero(shard_of == s)
                slot[mine] = at[s] + np.arange(len(mine))
                at[s] += len(mine)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(["bytes"] * n), batch.column(3), pa.array(slot), pa.nulls(n, pa.int32())], ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    return dealt.mapInArrow(run, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")


def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the whole table in eight shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
