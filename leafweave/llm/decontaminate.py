"""Benchmark decontamination by edit distance.

The CGK embedding walks along a string and, step by step, emits the symbol it
stands on and then moves on or stays, as a random bit of (step, symbol) says;
two strings a few edits apart give walks that differ in few steps, so edit
distance becomes Hamming distance.  Symbols are the bytes of lower-cased words
without outer punctuation, joined by one blank.  The walk is begun anew at
every byte of an item and of a document, so an edit spoils the walks that cross
it and no others, and a window's embedding needs no walk of its own for each
window that it lies in.

A hash key samples some steps of a walk.  Every repeat has bits and samples of
its own.  Equal keys vote for the window of the item's size that they imply:
the walk's place in the document less its offset in the item, give or take the
edits allowed.  How long the sampled walks are, and how many votes a window
needs, follows from simulated copies at the least similarity: the longest walks
that reach the target recall.  A window with the votes is verified: the item's
least edit distance, in characters, to any part of the window and what edits
can add around it must be small enough.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import textkit as tk

#: Least share of an item's characters that needn't be edited.
SIMILARITY = 0.8
#: Share of copies at the least similarity, simulated, whose window must get its votes.
RECALL = 0.98
#: Hash repeats, each with bits and samples of its own.
REPEATS = 2
#: Steps of the walks that a key may read; an item is searched by the longest that reach the recall.
STEPS = (1, 2, 3, 4, 6, 8, 11, 14, 18)
#: Chance that a walk moves on, and share of its steps that a key samples.
MOVE, SAMPLED = 0.75, 0.75
#: Walks are taken so long that a window still needs so many votes.
LEAST_VOTES = 10
#: Simulated copies of each length; lengths on a grid of this ratio, up to the longest.
TRIALS, GRID, LONGEST = 200, 1.2, 300
#: Before the edit distance, so many grams of that many bytes must occur in the window as all but this share of such copies keep.
GRAM, GRAM_LOSS = 5, 0.005
#: Bytes of item text that a task holds at once; more items are taken in blocks, a pass over the documents each.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are walked over at once.
SLICE = 1 << 16

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ODD = np.uint32(0x9E3779B1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) without outer punctuation; a word of punctuation only stays."""
    starts, ends, before = tk.words(data, offsets)
    if not len(starts):
        return starts, ends, before
    plain = ~_PUNCT[data]
    at = np.arange(len(data))
    first = np.minimum.accumulate(np.where(plain, at, len(data))[::-1])[::-1][starts]
    last = np.maximum.accumulate(np.where(plain, at, -1))[ends - 1] + 1
    bare = first >= ends
    return np.where(bare, starts, first), np.where(bare, ends, last), before


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words with one space after each, where each begins; its last value is the text's length)."""
    begins = np.concatenate([[0], np.cumsum(e - s + 1)])
    text = np.full(int(begins[-1]), 0x20, dtype=np.uint8)
    text[tk.spread(begins[:-1], e - s)] = data[tk.spread(s, e - s)]
    return text, begins


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


class Walks:
    """Keys of the walks of one repeat from every byte of a text.

    A walk of n steps is the end of a walk of more, so all lengths come from
    one pass: from the last step to the first, the key at a byte is the key one
    step later at that byte or the next, whichever the bit says, joined by the
    byte itself if the step is sampled.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        move = rng.random((max(STEPS), 256)) < MOVE
        #: By symbol, bit j is set if the walk moves on from it in the j-th step from the end.
        self.move = (move << np.arange(max(STEPS))[:, None]).sum(axis=0).astype(np.uint32)
        self.sampled = rng.random(max(STEPS)) < SAMPLED
        self.sampled[-4:] = self.sampled[[-n for n in STEPS]] = True
        self.salt = int(rng.integers(1, 1 << 31))

    def keys(self, text: np.ndarray, steps: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of steps, key at each byte); walks run on past the text's end over one same symbol."""
        n, symbol = len(text), text.astype(np.uint32) + np.uint32(self.salt)
        move, key = self.move[text].view(np.int32), np.zeros(n + 1, dtype=np.uint32)
        moves, here = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.uint32)
        for j in range(1, max(steps, default=0) + 1):
            # the step's bit as all bits or none, then one key or the other by it
            np.left_shift(move, 32 - j, out=moves)
            np.right_shift(moves, 31, out=moves)
            np.bitwise_xor(key[1:], key[:-1], out=here)
            np.bitwise_and(here, moves.view(np.uint32), out=here)
            key[:n] ^= here
            if self.sampled[-j]:
                key[:n] *= _ODD
                key[:n] += symbol
            if j in steps:
                yield j, key[:n]

    def reach(self, text: np.ndarray, steps: set[int]) -> dict[int, np.ndarray]:
        """The last byte that each walk reads, by number of steps."""
        n, out = len(text), {}
        for j in range(1, max(steps, default=0) + 1):
            at = np.arange(n)
            if j > 1:
                at = np.where(self.move[text] >> np.uint32(j - 1) & np.uint32(1), last[at + 1], last[at])
            last = np.append(at, n)
            out[j] = at
        return {j: out[j] for j in steps}


def _edited(rng: np.random.Generator, text: np.ndarray, edits: int, only: int) -> np.ndarray:
    """A copy with that many edits at random places: bytes replaced (0), removed (1), inserted (2), or all three (3)."""
    kind = rng.integers(0, 3, edits) if only == 3 else np.full(edits, only)
    out = text.copy()
    n = int((kind == 0).sum())
    out[rng.choice(len(out), n, replace=False)] = rng.integers(97, 121, n)
    out = np.delete(out, rng.choice(len(out), min(len(out) - 1, int((kind == 1).sum())), replace=False))
    return np.insert(out, rng.integers(0, len(out) + 1, int((kind == 2).sum())), rng.integers(97, 121, int((kind == 2).sum())))


def _width(size, similarity: float):
    """Diagonals of a bin: insertions and removals make up for each other in part, so votes keep closer together than the edits allow."""
    return np.maximum(8, np.ceil(0.4 * (1 - similarity) * np.asarray(size))).astype(np.int64)


@functools.cache
def votes_needed(length: int, similarity: float = SIMILARITY, recall: float = RECALL, repeats: int = REPEATS) -> tuple[int, int]:
    """(steps, votes) for items of that many bytes, from simulated copies with as many edits as the similarity allows."""
    edits, rng = int((1 - similarity) * length + 1e-9), np.random.default_rng(length)
    width = int(_width(length, similarity))
    items = rng.integers(97, 121, (TRIALS, length)).astype(np.uint8)
    items[rng.random(items.shape) < 1 / 6] = 0x20
    copies = [_edited(rng, x, edits, i % 4) for i, x in enumerate(items)]
    gap = np.zeros(max(STEPS) + 1, dtype=np.uint8)
    one, two = (np.concatenate([y for x in rows for y in (x, gap)]) for rows in (items, copies))
    begin = [np.cumsum([0] + [len(x) + len(gap) for x in rows])[:-1] for rows in (items, copies)]
    trial = [np.repeat(np.arange(TRIALS), [len(x) + len(gap) for x in rows]) for rows in (items, copies)]
    offset = [np.arange(len(t)) - b[t] for t, b in zip(trial, begin, strict=True)]
    shift = rng.integers(0, width, TRIALS)
    votes: dict[int, list[np.ndarray]] = {}
    for r in range(repeats):
        walk, steps = Walks(r), {s for s in STEPS if s <= length}
        inside = walk.reach(one, steps)
        for (s, a), (_, b) in zip(walk.keys(one, steps), walk.keys(two, steps), strict=True):
            ok = inside[s] - begin[0][trial[0]] < length
            a, b = (k + (t.astype(np.uint64) << tk.U64(32)) for k, t in ((a, trial[0]), (b, trial[1])))
            at = np.flatnonzero(ok)
            at = at[np.argsort(a[at], kind="stable")]
            lo, hi = np.searchsorted(a[at], b), np.searchsorted(a[at], b, side="right")
            from_ = at[tk.spread(lo, hi - lo)]
            to = np.repeat(np.arange(len(b)), hi - lo)
            bin_ = (offset[1][to] - offset[0][from_] + length + shift[trial[1][to]]) // width
            votes.setdefault(s, []).append(trial[1][to] * 64 + np.clip(bin_, 0, 62))
    best = (1, 1)
    for s, found in sorted(votes.items()):
        count = np.bincount(np.concatenate(found), minlength=TRIALS * 64).reshape(TRIALS, 64)
        most = np.sort((count[:, 1:] + count[:, :-1]).max(axis=1))[int(TRIALS * (1 - recall))]
        if most >= LEAST_VOTES or (s == best[0] and most > 0) or (best == (1, 1) and most > 0):
            best = (s, int(most))
    return best


def _on_grid(length: int) -> int:
    """The largest length of the grid that isn't larger; short lengths stand for themselves."""
    if length <= 24:
        return length
    return min(LONGEST, int(24 * GRID ** int(math.log(length / 24) / math.log(GRID) + 1e-9)))


class Index:
    """Keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, repeats: int = REPEATS) -> None:
        self.ids = [i for i, _ in items]
        data, offsets = tk.flat(_lowered(pa.array([t for _, t in items], pa.string())))
        s, e, before = _words(data, offsets)
        text, begins = _joined(data, s, e)
        limits = begins[before]
        self.norm = [text[a : max(a, b - 1)].tobytes().decode("utf-8") for a, b in zip(limits[:-1], limits[1:], strict=True)]
        self.words = np.diff(before)
        size = np.maximum(np.diff(limits) - 1, 0)
        self.size, self.width = size, _width(size, similarity)
        self.reach = np.ceil((1 - similarity) * size).astype(np.int64)
        plan = {n: votes_needed(_on_grid(n), similarity, RECALL, repeats) for n in {int(x) for x in size} if n}
        steps = np.array([plan[int(n)][0] if n else 0 for n in size], dtype=np.int64)
        self.grams = [_grams(text[a : a + n]) for a, n in zip(limits[:-1], size, strict=True)]
        self.grams_needed = [whole_grams(_on_grid(int(n)), similarity) for n in size]
        self.need = np.array([plan[int(n)][1] if n else 0 for n in size], dtype=np.int64)
        self.steps = {int(x) for x in steps if x}
        row = np.searchsorted(limits, np.arange(len(text)), side="right") - 1
        self.tables = []
        for r in range(repeats):
            walk, tables = Walks(r), {}
            last = walk.reach(text, self.steps)
            for n, key in walk.keys(text, self.steps):
                at = np.flatnonzero((steps[row] == n) & (last[n] < limits[row] + size[row]))
                order = at[np.argsort(key[at], kind="stable")]
                unique, first, count = np.unique(key[order], return_index=True, return_counts=True)
                have = np.zeros(1 << min(24, max(16, len(unique).bit_length() + 5)), dtype=bool)
                have[_slot(unique, have)] = True
                tables[n] = (unique, first, count, row[order], order - limits[row[order]], have)
            self.tables.append((walk, tables))

    def candidates(self, text: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item number, least and largest place at which the item would start) of windows with their votes."""
        span, zero, n = len(text) // 8 + (1 << 20), 1 << 19, len(self.ids)
        cast = []
        for walk, tables in self.tables:
            for steps, key in walk.keys(text, self.steps):
                unique, first, count, items, offsets, have = tables[steps]
                at = np.flatnonzero(have[_slot(key, have)])
                found = key[at]
                slot = np.minimum(np.searchsorted(unique, found), len(unique) - 1)
                ok = unique[slot] == found
                at, slot = at[ok], slot[ok]
                hit = tk.spread(first[slot], count[slot])
                item, place = items[hit], np.repeat(at, count[slot])
                row = np.searchsorted(limits, place, side="right") - 1
                cast.append((row * n + item) * span + (place - offsets[hit]) // self.width[item] + zero)
        if not cast:
            return
        window, votes = np.unique(np.concatenate(cast), return_counts=True)
        both = votes.copy()
        both[:-1] += np.where(window[1:] == window[:-1] + 1, votes[1:], 0)
        follows = np.append(False, window[1:] == window[:-1] + 1) if len(window) else np.zeros(0, dtype=bool)
        which = window // span
        need = self.need[which % n]
        # a bin alone is tried by itself only if no bin before it counts it too
        for k in np.flatnonzero((both >= need) & (~follows | (both > votes) | (votes >= need))).tolist():
            i = int(which[k] % n)
            low = (int(window[k] % span) - zero) * int(self.width[i])
            yield int(which[k] // n), i, low, low + 2 * int(self.width[i])


def _slot(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The keys' places in a table of a power of two."""
    return ((keys * _ODD) >> np.uint32(33 - len(table).bit_length())).astype(np.intp)


@functools.cache
def whole_grams(length: int, similarity: float = SIMILARITY) -> int:
    """Grams of an item of that many bytes that stay whole in all but GRAM_LOSS of simulated copies at the least similarity."""
    edits, rng = int((1 - similarity) * length + 1e-9), np.random.default_rng(length)
    edited = np.zeros((1000, length + 1), dtype=np.int32)
    np.cumsum(rng.random((1000, length)).argsort(axis=1) < edits, axis=1, out=edited[:, 1:])
    whole = (edited[:, GRAM:] == edited[:, :-GRAM]).sum(axis=1) if length >= GRAM else np.zeros(1000)
    return int(np.sort(whole)[int(1000 * GRAM_LOSS)])


def _grams(data: np.ndarray) -> np.ndarray:
    """16-bit hashes of all grams."""
    out = np.zeros(max(len(data) - GRAM + 1, 0), dtype=np.uint64)
    for k in range(GRAM):
        out = out * tk.U64(256) + data[k : k + len(out)]
    return ((out * tk.U64(0x9E3779B97F4A7C15)) >> tk.U64(48)).astype(np.int64)


def edit_distance(item: str, window: str) -> tuple[int, int]:
    """(least edit distance of the item to any part of the window, the part's end), by bit vectors."""
    at = window.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(window):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


HIT = "item_id long, distance long, similarity double, first_word long, n_words long"


def hits(index: Index, texts: pa.Array, similarity: float = SIMILARITY) -> list[tuple]:
    """(row, item id, distance, similarity, first word, words) of each item found in each text, at its best place."""
    data, offsets = tk.flat(_lowered(texts))
    best: dict[tuple[int, int], tuple] = {}
    for lo, hi in tk.slices(offsets, SLICE):
        own, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        s, e, before = _words(own, offs)
        if not len(s):
            continue
        joined, begins = _joined(own, s, e)
        limits = begins[before]
        grams, marked = _grams(joined), np.zeros(1 << 16, dtype=bool)
        done: dict[tuple[int, int], int] = {}  # how far the text has been searched for the item
        for row, i, low, high in sorted(index.candidates(joined, limits)):
            size, reach = int(index.size[i]), int(index.reach[i])
            a, b = max(low - reach, int(limits[row])), min(high + size + reach, int(limits[row + 1]) - 1)
            # only a window that begins and ends within what was searched is known already
            if a >= b or b <= done.get((row, i), -1) or best.get((lo + row, i), (0, 0, 1))[2] == 0:
                continue
            done[row, i] = b
            first = int(np.searchsorted(begins, a, side="right")) - 1
            marked[inside := grams[int(begins[first]) : max(b - GRAM + 1, 0)]] = True
            met = int(np.count_nonzero(marked[index.grams[i]]))
            marked[inside] = False
            if met < index.grams_needed[i]:
                continue
            last = min(int(np.searchsorted(begins, b)), int(before[row + 1]))
            window = joined[begins[first] : begins[last] - 1].tobytes().decode("utf-8")
            d, end = edit_distance(index.norm[i], window)
            share = 1 - d / len(index.norm[i])
            known = best.get((lo + row, i))
            if share >= similarity and (known is None or d < known[2]):
                length = edit_distance(index.norm[i][::-1], window[:end][::-1])[1]
                word = first - int(before[row]) + window[: end - length].count(" ")
                best[lo + row, i] = (lo + row, index.ids[i], d, share, word, int(index.words[i]))
    return [best[k] for k in sorted(best)]


def blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about that many bytes, so that none is too large to hold and to send to every task."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / most))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, distance, similarity, first_word, n_words.

    Null and empty texts contain nothing; items that are null, empty or
    without a word are never found; repeated rows are found alike.  Of equally
    good places the first counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(Index(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                if out := hits(index, batch.column(1), similarity):
                    row, item, d, share, first, size = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(d, pa.int64()), pa.array(share), pa.array(first, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "distance", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, f"doc_id long, {HIT}")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text contains no item; nothing is shuffled.

    Null and empty texts stay; items that are null, empty or without a word
    remove nothing; repeated rows stay or go together.
    """
    spark, out = docs.sparkSession, docs
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(Index(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[h[0] for h in hits(index, batch.column(batch.schema.get_field_index(text_col)), similarity)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document against every item of the benchmark table."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
