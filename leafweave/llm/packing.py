"""Best-fit packing of token sequences, with a bounded number of open bins.

Documents longer than a sequence are cut; all other pieces stay whole.  A
packing task is an online algorithm: it sees its pieces one after the other,
gives each its place at once, and holds nothing but a fixed number of open
bins.  A bitset has bit f set while some open bin has f tokens free, so the
fullest bin that still takes a piece is two integer operations away.  A piece
that fits nowhere opens a bin; if that is one too many, the fullest closes.

The order in which pieces arrive is Spark's sort: by block, that is a hash of
the document dealt over blocks of about BLOCK pieces, and within a block by
falling length.  Short pieces so come before the bins that they fill close.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import textkit as tk
from leafweave.llm import tokens, workdir

SEQUENCE = 2048
OPEN_BINS = 4096
#: Pieces of a block, about; fewer than three for each open bin.
BLOCK = 8192
#: Pieces that one packing task takes, about.
TASK_PIECES = 1_000_000


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32.

    A document is its ids followed by the end id; a null text counts as empty,
    so it is one piece of one token.  Longer ones are cut into full sequences,
    with the rest in front.  A null id stays null; repeated rows repeat their
    pieces; other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        for batch in batches:
            data, offsets = tk.flat(batch.column(1))
            for lo, hi in tk.slices(offsets):
                ids, before = enc.encode_flat(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids = np.insert(ids, before[1:], end_id).astype("<u4")
                before = before + np.arange(len(before))
                total = np.diff(before)
                count = -(-total // sequence)
                first = total - (count - 1) * sequence
                row = np.repeat(np.arange(hi - lo), count)
                piece = tk.spread(np.zeros(hi - lo, dtype=np.int64), count)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * sequence)
                length = np.where(piece == 0, first[row], sequence)
                view, at = memoryview(ids.tobytes()), 4 * (before[row] + start)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Places lengths one after the other, each for good."""

    def __init__(self, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> None:
        self.sequence, self.most = sequence, open_bins
        self.free = 0  # bit f: some open bin has f tokens free
        self.bins_of: list[list[int]] = [[] for _ in range(sequence + 1)]
        self.opened = self.closed = self.n_open = 0

    def _take(self, free: int) -> int:
        held = self.bins_of[free]
        b = held.pop()
        if not held:
            self.free ^= 1 << free
        self.n_open -= 1
        return b

    def place(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """(bin, offset) of each piece in the order given."""
        bins, offsets = [], []
        for n in lengths:
            fits = self.free >> n
            if fits:
                free = n + (fits & -fits).bit_length() - 1
                b = self._take(free)
            else:
                free, b = self.sequence, self.opened
                self.opened += 1
                if self.n_open == self.most:
                    self._take((self.free & -self.free).bit_length() - 1)
                    self.closed += 1
            bins.append(b)
            offsets.append(self.sequence - free)
            if free > n:
                self.bins_of[free - n].append(b)
                self.free |= 1 << (free - n)
                self.n_open += 1
        return bins, offsets


def pack(rows: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of 1 to ``sequence``.

    ``rows`` should be materialised, since it is counted and then read.  Tasks
    are independent: each wastes at most its own open bins, so the number of
    sequences is the least possible plus a share that falls with the input.
    Two rows alike may swap places between runs; nothing else can change.
    Columns that are called sequence_id or offset already stay, with an
    underscore added; an empty table gives an empty result.
    """
    count = rows.count()
    tasks, blocks = max(1, math.ceil(count / task_pieces)), max(1, round(count / block))
    own = [c + "_" * (c in ("sequence_id", "offset")) for c in rows.columns]
    rows = rows.toDF(*own)
    at = F.xxhash64(*[c for c in ("doc_id", "piece") if c in own], "length")
    dealt = rows.repartition(tasks, F.pmod(at, F.lit(blocks))).sortWithinPartitions(F.pmod(at, F.lit(blocks)), F.desc("length"), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        fit = BestFit(sequence, open_bins)
        for b in batches:
            bins, offsets = fit.place(b.column(b.schema.get_field_index("length")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(bins, dtype=np.int64) + base), pa.array(offsets, pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents packed into sequences of 2,048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(workdir.cut(pieces(docs, tokens.default_vocabulary())))
