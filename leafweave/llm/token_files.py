"""Token-id files: flat unsigned integers with 64-bit document offsets.

A data set is a folder with, for each partition k of ascending doc_id ranges,

* ``part-k.bin``: the ids of its documents one after the other, little-endian,
  in the smallest unsigned type that holds the vocabulary (two bytes for up to
  65,536 ids, else four), nothing else;
* ``part-k.idx``: the documents' int64 ids, then uint64 offsets (one more than
  documents) into ``part-k.bin``, counted in ids.

A reader maps both into memory.  The manifest (a DataFrame of one row a
partition) adds the partition's base: the number of ids in all partitions
before it, a prefix sum over as many rows as there are partitions.  Documents
without an id come first; the manifest has their number, and the index file
a zero for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import textkit as tk
from leafweave.llm import tokens, workdir

MANIFEST = "part long, path string, n_docs long, n_null long, n_ids long, width int, base long, doc_base long"


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and writes the files; returns the manifest.

    Null texts count as empty, so they hold the end id alone.  Null ids come
    first and are read back as null.  Rows that share an id follow each other,
    ordered by text; other columns aren't written.  An empty table gives an empty
    manifest.  A retried task writes the same bytes under a name of its own and
    renames it, so a lost executor leaves no half-written part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(workdir.partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        enc = tokens.encoder(vocabulary)
        fs, root = workdir.open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}"
        mine = f"{name}.{context.taskAttemptId()}-{os.getpid()}"
        ids_of, sizes, n_null = [], [], 0
        with fs.open_output_stream(f"{mine}.bin") as out:
            for batch in batches:
                data, offsets = tk.flat(batch.column(1))
                ids_of.append(np.asarray(batch.column(0).fill_null(0)))
                n_null += batch.column(0).null_count
                for lo, hi in tk.slices(offsets):
                    ids, before = enc.encode_flat(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    ids = np.insert(ids, before[1:], end_id)  # after each row's own ids
                    sizes.append(np.diff(before) + 1)
                    out.write(ids.astype(enc.dtype.newbyteorder("<"), copy=False).tobytes())
        n = sum(len(x) for x in ids_of)
        if n == 0:
            fs.delete_file(f"{mine}.bin")
            return
        offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        with fs.open_output_stream(f"{mine}.idx") as out:
            out.write(np.concatenate(ids_of).astype("<i8").tobytes())
            out.write(offs.tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{mine}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [f"{folder}/part-{part:06d}"], "n_docs": pa.array([n], pa.int64()), "n_null": pa.array([n_null], pa.int64()), "n_ids": pa.array([int(offs[-1])], pa.int64()), "width": pa.array([enc.dtype.itemsize], pa.int32())})

    parts = rows.mapInArrow(run, "part long, path string, n_docs long, n_null long, n_ids long, width int").collect()  # one row a partition
    base = doc_base = 0
    manifest = []
    for r in sorted(parts, key=lambda r: r["part"]):
        manifest.append((r["part"], r["path"], r["n_docs"], r["n_null"], r["n_ids"], r["width"], base, doc_base))
        base, doc_base = base + r["n_ids"], doc_base + r["n_docs"]
    return spark.createDataFrame(manifest, MANIFEST)


def open_part(path: str, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc ids, offsets) of a part: views into mapped files where the store is a file system, else read."""
    fs, at = workdir.open_fs(path)
    if fs.type_name == "local":
        index = np.memmap(f"{at}.idx", dtype="<i8", mode="r")
        ids = np.memmap(f"{at}.bin", dtype=f"<u{width}", mode="r")
    else:
        with fs.open_input_file(f"{at}.idx") as f:
            index = np.frombuffer(f.read_buffer(), dtype="<i8")
        with fs.open_input_file(f"{at}.bin") as f:
            ids = np.frombuffer(f.read_buffer(), dtype=f"<u{width}")
    return ids, index[:n_docs], index[n_docs:].view("<u8").astype(np.int64)


def _ids(docs: np.ndarray, n_null: int, lo: int = 0) -> pa.Array:
    """Document ids from the lo-th on, of which the part's first are null."""
    return pa.array(np.array(docs), mask=np.arange(lo, lo + len(docs)) < n_null)


def read(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: its ids (array of long) and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            ids, docs, offs = open_part(r["path"], r["n_docs"], r["width"])
            for lo in range(0, len(docs), 1000):
                hi = min(lo + 1000, len(docs))
                values = pa.array(ids[offs[lo] : offs[hi]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([_ids(docs[lo:hi], r["n_null"], lo), pa.array(r["base"] + offs[lo:hi]), pa.ListArray.from_arrays(pa.array((offs[lo : hi + 1] - offs[lo]).astype(np.int32)), values)], ["doc_id", "start", "ids"])

    return _one_each(manifest).mapInArrow(run, "doc_id long, start long, ids array<long>")


def digests(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            ids, docs, offs = open_part(r["path"], r["n_docs"], r["width"])
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([_ids(docs, r["n_null"]), pa.array(r["base"] + offs[:-1]), pa.array(np.diff(offs)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _one_each(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _one_each(manifest: DataFrame) -> DataFrame:
    """A task for each part."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "part")


def token_file_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document of the table through files and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write(docs, workdir.new_folder(spark, "token-files"), tokens.default_vocabulary())
    return digests(manifest)
