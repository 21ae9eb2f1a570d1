"""Substring deduplication by bytes, with a column-wise collection BWT.

The Burrows-Wheeler transform of many strings is built from their ends: each
round inserts one symbol of every string, that is the suffix one symbol longer,
at the place that the transform so far implies (its symbol's rank).  Common
prefixes of neighbouring suffixes are updated in the same round, as one more
than the least common prefix between the places of the suffixes without their
first symbol.  The arrays live in sequential files that each round reads and
rewrites; they stay in memory while they are small.

Only bytes that may be repeated get here: pieces that share an anchor with
another piece (see ``anchors``).  Pieces with equal bytes are one string; of
strings that share an anchor with a different one, windows whose hash occurs
twice are inserted.  Hashes only choose what is inserted; two windows count as
equal if the common prefix of their suffixes is a window long.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import anchors
from leafweave.llm import textkit as tk

WINDOW_BYTES = 200
#: Bytes of an anchor.
GRAM_BYTES = 64
#: Keys with more pieces than this are split by whole windows; a piece has up to 137 of them, so this is rarer than for words.
KEY_PIECES = 5000
#: Symbols of one collection, about: strings of a larger one are dealt to several by their anchors.
COLLECTION = 4_000_000
#: Arrays of up to so many bytes stay in memory.
IN_MEMORY = 64 << 20
_BLOCK = 64


class SequentialFile:
    """An array that is only read and written as a whole, front to back."""

    def __init__(self, dtype: str, in_memory: int = IN_MEMORY) -> None:
        self.dtype = np.dtype(dtype)
        self.file = tempfile.SpooledTemporaryFile(max_size=in_memory)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), dtype=self.dtype)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(np.ascontiguousarray(values, dtype=self.dtype).data)

    def close(self) -> None:
        self.file.close()


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both ends included, for many ranges at once."""
    n = len(values)
    padded = np.full(-(-n // _BLOCK) * _BLOCK, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    levels = [padded.reshape(-1, _BLOCK).min(axis=1)]
    while len(levels[-1]) > 1:
        step = 1 << (len(levels) - 1)
        if step >= len(levels[-1]):
            break
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    best = np.full(len(lo), np.iinfo(values.dtype).max, dtype=values.dtype)
    b_lo, b_hi = lo // _BLOCK + 1, hi // _BLOCK  # whole blocks b_lo .. b_hi - 1
    span = b_hi - b_lo
    many = np.flatnonzero(span > 0)
    level = np.frexp(span[many].astype(np.float64))[1] - 1
    for k in np.unique(level):
        at = many[level == k]
        best[at] = np.minimum(levels[k][b_lo[at]], levels[k][b_hi[at] - (1 << k)])
    same = span < 0
    step = np.arange(_BLOCK)
    for part in np.array_split(np.arange(len(lo)), max(1, len(lo) // 20_000)):
        left = lo[part, None] + step
        end = np.where(same[part], hi[part], b_lo[part] * _BLOCK - 1)
        v = padded[np.minimum(left, len(padded) - 1)]
        best[part] = np.minimum(best[part], np.where(left <= end[:, None], v, np.iinfo(values.dtype).max).min(axis=1))
        right = b_hi[part, None] * _BLOCK + step
        v = padded[np.minimum(right, len(padded) - 1)]
        ok = (right <= hi[part, None]) & ~same[part, None]
        best[part] = np.minimum(best[part], np.where(ok, v, np.iinfo(values.dtype).max).min(axis=1))
    return best


def build(strings: list[bytes], in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, common prefixes, string, suffix length) of the collection, in suffix order.

    Symbols are bytes plus one; 0 ends a string.  The ends of different
    strings sort by string number and never count as equal.
    """
    m = len(strings)
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def symbol(which: np.ndarray, length: int) -> np.ndarray:
        """The symbol in front of the suffixes of that length."""
        at = sizes[which] - length - 1
        out = np.zeros(len(which), dtype=np.uint16)
        out[at >= 0] = text[(first[which] + at)[at >= 0]].astype(np.uint16) + 1
        return out

    bwt, lcp = SequentialFile("u2", in_memory), SequentialFile("u2", in_memory)
    owner, suffix = SequentialFile("u4", in_memory), SequentialFile("u2", in_memory)
    try:
        live, place = np.arange(m), np.arange(m)
        bwt.write(symbol(live, 0))
        lcp.write(np.zeros(m))
        owner.write(live)
        suffix.write(np.zeros(m))
        for length in range(1, int(sizes.max(initial=0)) + 1):
            keep = sizes[live] >= length
            live, place = live[keep], place[keep]
            b, p = bwt.read(), lcp.read()
            # where each symbol's suffixes begin, and the rank of each symbol among its like
            by_symbol = np.argsort(b, kind="stable")
            rank = np.empty(len(b), dtype=np.int64)
            rank[by_symbol] = np.arange(len(b))
            total = np.bincount(b, minlength=257)
            ended = total[0]
            # symbols 0 aren't suffixes; the m ends stand in front of all others
            to = rank[place] - ended + m
            order = np.argsort(to)
            live, place, to = live[order], place[order], to[order]
            r, s = rank[place], b[place]
            before, after = np.maximum(r - 1, 0), np.minimum(r + 1, len(b) - 1)
            has_before = (r > 0) & (b[by_symbol[before]] == s)
            has_after = (r + 1 < len(b)) & (b[by_symbol[after]] == s)
            with_before = np.zeros(len(to), dtype=np.uint16)
            with_after = np.zeros(len(to), dtype=np.uint16)
            with_before[has_before] = 1 + _range_min(p, by_symbol[before[has_before]] + 1, place[has_before])
            with_after[has_after] = 1 + _range_min(p, place[has_after] + 1, by_symbol[after[has_after]])
            slot = to - np.arange(len(to))  # in the array before the insertion
            p = np.insert(p, slot, with_before)
            follows = to + 1 < len(p)
            p[to[follows] + 1] = with_after[follows]
            bwt.write(np.insert(b, slot, symbol(live, length)))
            lcp.write(p)
            owner.write(np.insert(owner.read(), slot, live))
            suffix.write(np.insert(suffix.read(), slot, length))
            place = to
        return bwt.read(), lcp.read(), owner.read().astype(np.int64), suffix.read().astype(np.int64)
    finally:
        for x in (bwt, lcp, owner, suffix):
            x.close()


def repeats(lcp: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
    """For each suffix its class of equal first ``length`` symbols; -1 for shorter suffixes."""
    joined = lcp >= length
    joined[:1] = False
    return np.where(suffix >= length, np.cumsum(~joined) - 1, -1)


def resolve(plan: anchors.Plan):
    def solve(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, copies = anchors.distinct(rows)
        twice = {r[5] for r in copies}
        gone = [r for r in [*copies, *(r for r in first if r[5] in twice)] if not r[4]]
        whole = tuple(np.array([f(r) for r in gone], dtype=np.int64) for f in (lambda r: r[1], lambda r: r[2], lambda r: r[2] + r[3]))
        found = windows([(*r[:4], r[4] or r[5] in twice, r[5]) for r in anchors.shared(first)])
        return tuple(np.concatenate(x) for x in zip(whole, found, strict=True))

    def windows(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Repeated windows of different strings, without those of known ones."""
        rows.sort(key=lambda r: r[0])
        n = len(rows)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        starts = np.cumsum([0] + [len(r[5]) for r in rows])
        data = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8)
        count = np.array([r[3] for r in rows], dtype=np.int64)
        # windows whose hash occurs twice, and the piece's run from the first to the last of them
        at, piece = tk.spread(starts[:-1], count), np.repeat(np.arange(n), count)
        hashes = tk.Prefix.of_bytes(data).hash(at, at + plan.length)
        order = np.argsort(hashes)
        alike = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:]] |= alike
        twice[order[:-1]] |= alike
        chosen = np.flatnonzero(twice)
        if not len(chosen):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        pieces, edge = np.unique(piece[chosen], return_index=True)
        lo = at[chosen[edge]]
        hi = at[chosen[np.append(edge[1:], len(chosen)) - 1]]
        out: list[tuple[np.ndarray, ...]] = []
        # a collection takes whole keys, so no two equal windows are parted
        key = np.array([rows[i][0] for i in pieces], dtype=np.int64)
        heads = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        begun = 0
        for i in range(1, len(heads)):
            size = int((hi[heads[begun] : heads[i]] - lo[heads[begun] : heads[i]] + plan.length).sum())
            if size >= COLLECTION or i == len(heads) - 1:
                part = slice(heads[begun], heads[i])
                out.append(_collection(plan, rows, data, starts, pieces[part], lo[part], hi[part]))
                begun = i
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return solve


def _collection(plan: anchors.Plan, rows: list[tuple], data: np.ndarray, starts: np.ndarray, pieces: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of the pieces' runs lo..hi, as doc_id, start, stop."""
    texts: dict[bytes, int] = {}
    which = np.array([texts.setdefault(data[a : b + plan.length].tobytes(), len(texts)) for a, b in zip(lo, hi, strict=True)], dtype=np.int64)
    held = np.bincount(which, minlength=len(texts))
    _, lcp, owner, suffix = build(list(texts))
    classes = repeats(lcp, suffix, plan.length)
    full = classes >= 0
    weight = np.bincount(classes[full], weights=held[owner[full]], minlength=len(lcp) + 1)
    hit = full & (weight[classes] >= 2)
    size = np.array([len(x) for x in texts], dtype=np.int64)
    base = np.cumsum(size) - size
    marks = np.zeros(int(size.sum()) + 1, dtype=bool)
    marks[(base + size)[owner[hit]] - suffix[hit]] = True
    doc, start, stop = [], [], []
    for i, a, b, w in zip(pieces.tolist(), lo.tolist(), hi.tolist(), which.tolist(), strict=True):
        _, d, s, _, known, _ = rows[i]
        if known:
            continue
        run = np.flatnonzero(np.diff(np.concatenate([[0], marks[base[w] : base[w] + b - a + 1].view(np.int8), [0]])))
        for u, v in zip(run[::2].tolist(), run[1::2].tolist(), strict=True):
            doc.append(d)
            start.append(s + a - starts[i] + u)
            stop.append(s + a - starts[i] + v)
    return np.array(doc, dtype=np.int64), np.array(start, dtype=np.int64), np.array(stop, dtype=np.int64)


def dedup(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, id_col: str = "doc_id", text_col: str = "text", key_pieces: int = KEY_PIECES) -> DataFrame:
    """Removes each byte covered by a string of ``window`` bytes that also starts elsewhere.

    Gives doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept,
    the bytes that remain.  A null text counts as empty.  Rows with a null id
    pass unchanged and are no other document's "elsewhere".  Rows that share an
    id count as one document that has the windows of all of them.
    """
    plan = anchors.Plan("byte", window, gram, keep_first=False, key_pieces=key_pieces)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = anchors.by_document(rows)
    found = anchors.ranges(dealt, rows, plan, resolve)

    def finish(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, ranges: list) -> pa.RecordBatch:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for i, (start, stop) in enumerate(ranges):
            own = data[offsets[i] : offsets[i + 1]].tobytes()
            rest, at, spans = [], 0, 0
            for s, e in anchors.covered(start, stop, window):
                if s >= len(own):
                    break
                rest.append(own[at:s])
                at, spans = min(e, len(own)), spans + 1
            rest.append(own[at:])
            kept.append(b"".join(rest))
            n_bytes.append(len(own))
            n_removed.append(len(own) - len(kept[-1]))
            n_spans.append(spans)
        return pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return anchors.applied(dealt, found, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_array_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: strings of 200 bytes over the whole table."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
