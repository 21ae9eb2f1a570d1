"""Substring deduplication by words, with prefix-partitioned suffix trees.

Suffixes that can share a window lie under the same anchor (see ``anchors``),
so tasks get whole anchors; anchors with too many suffixes for a task are split
by prefixes as long as a window.  A task holds its strings once, as word
numbers, and its suffixes as places in them.  It splits the suffixes by
prefixes of growing length until each group fits its memory bound, sorts a
group's suffixes and takes common-prefix lengths of neighbours; these are the
leaves and internal nodes of the group's subtree.  An internal node at least a
window deep is a maximal repeat, and the suffixes below it start with the same
window.  Equal strings are one string of the tree, with its first owner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import anchors
from leafweave.llm import textkit as tk

WINDOW_WORDS = 20
#: Words of an anchor.
GRAM_WORDS = 8
#: Suffixes of one subtree, at most, unless they agree in a whole window; a subtree takes a word number for each word of their windows.
GROUP = 20_000


def prefix_groups(text: np.ndarray, at: np.ndarray, depth: int, limit: int = GROUP) -> Iterator[np.ndarray]:
    """Places of suffixes by shared prefixes, each as long as it must be for the limit, up to the depth."""
    todo = [(at, 0)]
    while todo:
        rows, done = todo.pop()
        if len(rows) <= limit or done == depth:
            yield rows
            continue
        column = text[rows + done]
        order = np.argsort(column, kind="stable")
        cuts = np.flatnonzero(np.diff(column[order])) + 1
        todo += [(part, done + 1) for part in np.split(rows[order], cuts)]


def subtree(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before, up to the depth): the tree in its array form."""
    suffixes = text[at[:, None] + np.arange(depth)]
    order = np.argsort(np.ascontiguousarray(suffixes.astype(">u4")).view(f"S{4 * depth}").ravel(), kind="stable")
    lcp = np.zeros(len(order), dtype=np.int64)
    differ = suffixes[order[1:]] != suffixes[order[:-1]]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return at[order], lcp


def internal_nodes(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of internal nodes of that depth at least, children before parents."""
    stack, out = [(0, 0)], []
    for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        left = i - 1
        while stack[-1][0] > depth:
            deep, left = stack.pop()
            if deep >= least:
                out.append((deep, left, i - 1))
        if stack[-1][0] < depth:
            stack.append((depth, left))
    return out


def resolve(plan: anchors.Plan):
    def solve(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = plan.length
        first, copies = anchors.distinct(rows)
        out = [tuple(np.array([f(r) for r in copies], dtype=np.int64) for f in (lambda r: r[1], lambda r: r[2], lambda r: r[2] + r[3]))]
        strings = anchors.shared(first)
        if strings:
            numbers: dict[bytes, int] = {}
            words = [[numbers.setdefault(w, len(numbers) + 1) for w in r[5].split(b" ")] for r in strings]
            size = np.array([len(w) for w in words], dtype=np.int64)
            count = np.array([r[3] for r in strings], dtype=np.int64)
            text = np.fromiter((i for w in words for i in w), dtype=np.uint32, count=int(size.sum()))
            begin = np.cumsum(size) - size
            # by place in the text: the suffix's document and start
            doc = np.repeat(np.array([r[1] for r in strings], dtype=np.int64), size)
            start = np.arange(len(text)) + np.repeat(np.array([r[2] for r in strings], dtype=np.int64) - begin, size)
            for group in prefix_groups(text, tk.spread(begin, count), length):
                leaves, lcp = subtree(text, group, length)
                for _, lo, hi in internal_nodes(lcp, length):
                    below = leaves[lo : hi + 1]
                    below = below[np.lexsort((start[below], doc[below]))][1:]  # all but the first
                    out.append((doc[below], start[below], start[below] + 1))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return solve


def dedup(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, id_col: str = "doc_id", text_col: str = "text", key_pieces: int = anchors.KEY_PIECES) -> DataFrame:
    """Removes each word covered by a window that also starts earlier; gives doc_id, n_words, n_removed, kept.

    Earlier means a smaller id, or an earlier start in the same document.  A
    null or empty text has no words.  Rows with a null id pass unchanged and
    are no one's earlier occurrence.  Rows that share an id count as one
    document that has the windows of all of them.
    """
    plan = anchors.Plan("word", window, gram, keep_first=True, key_pieces=key_pieces)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = anchors.by_document(rows)
    found = anchors.ranges(dealt, rows, plan, resolve)

    def finish(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, ranges: list) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for i, (start, stop) in enumerate(ranges):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split(None)
            n_words.append(len(words))
            rest, at = [], 0
            for s, e in anchors.covered(start, stop, window):
                rest += words[at:s]
                at = max(at, min(e, len(words)))
            rest += words[at:]
            n_removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest).decode("utf-8"))
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return anchors.applied(dealt, found, finish, "doc_id long, n_words long, n_removed long, kept string")


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: windows of 20 words over the whole table."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
