"""Content-chosen pieces: where equal windows of a corpus can be at all.

A window is ``length`` consecutive symbols (bytes, or words) of one document.
In each window the run of ``gram`` symbols with the least hash is its anchor,
so equal windows have equal anchors at equal places.  Consecutive windows that
share an anchor form a piece, about one for each half window.  A repeated
window thus lies in two pieces whose anchors hash alike (their ``key``).

Hashes only choose what is looked at; symbols decide.  A scan task compares
pieces that hash alike symbol by symbol and combines the equal ones, so that no
group of copies leaves a task as more than one row.  Of what is left, every
piece that shares its key with another one is fetched with its symbols and
goes to the task of its key.  A key with too many pieces for a task is split
by longer prefixes, that is by whole windows: an aggregate on their symbols
finds the first of each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafweave.llm import textkit as tk
from leafweave.llm import workdir

#: Keys with more pieces than this are split by whole windows, not held in one task.
KEY_PIECES = 500
#: Parts into which the rows of one window are dealt for the join with its first occurrence.
SALTS = 16
#: Bytes that are compared at once.
_COMPARED = 4 << 20


@dataclass(frozen=True)
class Plan:
    """``unit`` is "byte" or "word"; ``keep_first``: the first of equal windows stays."""

    unit: str
    length: int
    gram: int
    keep_first: bool
    key_pieces: int = KEY_PIECES

    def __post_init__(self) -> None:
        if not 1 <= self.gram <= self.length or 2 * self.length > tk.Prefix.LONGEST:
            raise ValueError("gram must be 1 to length, and length at most 511")


def symbols(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[tk.Prefix, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row limits in symbols, text, its byte start and byte end of each symbol).

    The text of words has one blank between neighbours, so sequences of words
    are equal if their bytes are.
    """
    if unit == "byte":
        at = np.arange(len(data) + 1)
        return tk.Prefix.of_bytes(data), offsets, data, at[:-1], at[1:]
    starts, ends, before = tk.words(data, offsets)
    prefix = tk.Prefix.of_bytes(data)
    # a word too long for the hash is told apart by blocks of it
    hashes = prefix.hash(starts, np.minimum(ends, starts + tk.Prefix.LONGEST))
    for i in np.flatnonzero(ends - starts > tk.Prefix.LONGEST):
        for s in range(starts[i], ends[i], tk.Prefix.LONGEST):
            e = min(s + tk.Prefix.LONGEST, ends[i])
            hashes[i : i + 1] = tk.mix(hashes[i : i + 1] * tk.U64(3) + prefix.hash(np.array([s]), np.array([e])))
    size = ends - starts
    begins = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    text[tk.spread(begins, size)] = data[tk.spread(starts, size)]
    return tk.Prefix(hashes), before, text, begins, begins + size


def alike(text: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[one : one + size] and text[two : two + size] are equal, for many at once."""
    same = np.ones(len(size), dtype=bool)
    upto = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _COMPARED, side="right")))
        part = slice(lo, hi)
        differ = np.flatnonzero(text[tk.spread(one[part], size[part])] != text[tk.spread(two[part], size[part])])
        same[lo + np.searchsorted(upto[part] - (upto[lo - 1] if lo else 0), differ, side="right")] = False
        lo = hi
    return same


def pieces(plan: Plan, prefix: tk.Prefix, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, number of starts, key, piece hash) of all pieces; starts count from the row's begin."""
    n, w = len(prefix.sums) - 1, plan.length - plan.gram + 1
    if n < plan.length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = prefix.fixed(plan.gram) if n > plan.gram else prefix.hash(np.array([0]), np.array([n]))
    if len(grams) == n - plan.gram:  # the last start
        grams = np.append(grams, prefix.hash(np.array([n - plan.gram]), np.array([n])))
    place = tk.U64((1 << int(n).bit_length()) - 1)
    least = tk.sliding_min((tk.mix(grams) & ~place) | np.arange(len(grams), dtype=np.uint64), w)
    anchor = (least & place).astype(np.int64)
    starts = np.arange(len(anchor))
    row = np.searchsorted(limits, starts, side="right") - 1
    ok = starts + plan.length <= limits[row + 1]
    starts, anchor, row = starts[ok], anchor[ok], row[ok]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    s0, row = starts[at], row[at]
    return row, s0 - limits[row], count, grams[anchor[at]], prefix.hash(s0, s0 + count - 1 + plan.length)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


#: start is packed with the number of starts, which is below 1024.
PIECE = "key long, doc_id long, place long, copies int"


def _runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of ranges of starts, those that follow each other in a document joined, up to 1,000 starts each."""
    if not len(doc):
        return doc.astype(np.int64), start.astype(np.int64)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + count)[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != end[:-1]))
    at = np.flatnonzero(new)
    first, size = start[at], end[np.append(at[1:], len(doc)) - 1] - start[at]
    parts = -(-size // 1000)
    k = tk.spread(np.zeros(len(at), dtype=np.int64), parts)
    begin = np.repeat(first, parts) + 1000 * k
    return np.repeat(doc[at], parts), begin << 10 | np.minimum(np.repeat(first + size, parts) - begin, 1000)


def scan(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row for each different piece of a scan task, and what needs no more looking at.

    Equal pieces of one task, symbol by symbol, are combined: a row with the
    first one's place and their number.  Further ones of a document that follow
    each other are one row, with ``copies`` 0 and a key of its own, so that no
    key gathers them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        texts, base = [], 0
        for batch in batches:
            data, offsets = tk.flat(batch.column(1))
            ids = np.asarray(batch.column(0))
            for lo, hi in tk.slices(offsets):
                prefix, limits, text, begin, end = symbols(plan.unit, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, start, count, key, piece = pieces(plan, prefix, limits)
                if len(row):
                    first = limits[row] + start
                    at = begin[first]
                    found.append((key, piece, ids[lo:hi][row], start << 10 | count, base + at, end[first + count - 2 + plan.length] - at))
                    texts.append(text)
                    base += len(text)
        if not found:
            return
        key, piece, doc, place, at, size = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.concatenate(texts)
        del found, texts
        order = np.lexsort((place, doc, piece, key))
        key, piece, doc, place, at, size = key[order], piece[order], doc[order], place[order], at[order], size[order]
        if len(key) > 1:  # rows of the table that share an id count once
            own = np.ones(len(key), dtype=bool)
            own[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            key, piece, doc, place, at, size = key[own], piece[own], doc[own], place[own], at[own], size[own]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        more = np.flatnonzero(~new)
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))[more]
        differ = size[more] != size[head]
        differ[~differ] = ~alike(text, at[more[~differ]], at[head[~differ]], size[more[~differ]])
        other = more[differ]  # hashes alike, symbols not
        copies = np.zeros(len(key), dtype=np.int32)
        copies[new] = copies[other] = 1
        np.add.at(copies, head[~differ], 1)
        more = more[~differ]
        run_doc, run_place = _runs(doc[more], place[more] >> 10, place[more] & 1023)
        rest = np.delete(np.arange(len(key)), more)
        run_key = tk.mix(tk.mix(run_doc.astype(np.uint64)) + run_place.astype(np.uint64))
        key, doc, place = np.concatenate([key[rest], run_key]), np.concatenate([doc[rest], run_doc]), np.concatenate([place[rest], run_place])
        copies = np.concatenate([copies[rest], np.zeros(len(run_doc), dtype=np.int32)])
        for lo in range(0, len(key), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([_long(key[part]), _long(doc[part]), _long(place[part]), pa.array(copies[part])], ["key", "doc_id", "place", "copies"])

    return docs.where("doc_id is not null").mapInArrow(run, PIECE)


def judged(found: DataFrame, plan: Plan) -> DataFrame:
    """Pieces that repeat or may share a window: key, doc_id, place, rivals, state.

    ``rivals``: pieces under the key.  ``state``: "gone" if all its windows are
    to be removed, as an equal piece of its task shows; "open" if that depends
    on rivals; "known" if it is gone and rivals must still see it.
    """
    under = Window.partitionBy("key")
    before = under.orderBy("doc_id", "place")
    again = (F.lag("doc_id").over(before) == F.col("doc_id")) & (F.lag("place").over(before) == F.col("place"))
    seen = found.withColumn("again", F.coalesce(again, F.lit(False))).where("not again or copies = 0").withColumn("rivals", F.sum((F.col("copies") > 0).cast("int")).over(under))
    copy, rival = F.col("copies") == 0, F.col("rivals") > 1
    if plan.keep_first:
        state = F.when(copy, "gone").when(rival, "open")
    else:
        state = F.when(copy, "gone").when(rival, F.when(F.col("copies") > 1, "known").otherwise("open")).when(F.col("copies") > 1, "gone")
    asked = F.col("state") != "gone"
    return seen.withColumn("state", state).where("state is not null").select(F.when(asked, F.col("key")).alias("key"), "doc_id", "place", F.when(asked, F.col("rivals")).alias("rivals"), "state")


def by_document(docs: DataFrame) -> DataFrame:
    """Ids and texts, dealt by id once; every join below uses this one exchange."""
    return docs.repartition(workdir.partitions(docs), "doc_id")


WINDOWS = "key long, doc_id long, start long, count int, known boolean, text binary"


def opened(dealt: DataFrame, todo: DataFrame, plan: Plan) -> DataFrame:
    """Fetches the symbols of open and known pieces.

    A piece of an uncrowded key gives one row with its bytes, a piece of a
    crowded key a row for each window with the window's.
    """
    per_doc = todo.where("state in ('open', 'known')").groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "rivals", "state")).alias("asked"))
    both = dealt.join(per_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.flat(batch.column(1))
            ids, asked = batch.column(0).to_pylist(), batch.column(2)
            edges = asked.offsets.to_numpy()
            fields = asked.values
            key, place = fields.field("key").to_numpy(), fields.field("place").to_numpy()
            crowded = fields.field("rivals").to_numpy() > plan.key_pieces
            known = np.array(fields.field("state").to_pylist(), dtype=object) == "known"
            out: list[tuple] = []
            for i, doc in enumerate(ids):
                own = data[offsets[i] : offsets[i + 1]]
                a, b = edges[i], edges[i + 1]
                _, _, text, starts, ends = symbols(plan.unit, own, np.array([0, len(own)]))
                for j in range(a, b):
                    s, n = int(place[j]) >> 10, int(place[j]) & 1023
                    if crowded[j]:
                        for t in range(s, s + n):
                            out.append((key[j], doc, t, 1, bool(known[j]), text[starts[t] : ends[t - 1 + plan.length]].tobytes()))
                    else:
                        out.append((key[j], doc, s, n, bool(known[j]), text[starts[s] : ends[s + n - 2 + plan.length]].tobytes()))
                if len(out) > 20_000:
                    yield _windows(out)
                    out = []
            if out:
                yield _windows(out)

    return both.mapInArrow(run, WINDOWS)


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    key, doc, start, count, known, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int32()), pa.array(known), pa.array(text, pa.binary())], ["key", "doc_id", "start", "count", "known", "text"])


RANGE = "doc_id long, start long, stop long"


def crowded_ranges(windows: DataFrame, plan: Plan) -> DataFrame:
    """Starts of repeated windows under crowded keys: an aggregate on the windows' symbols that combines before it shuffles, and a salted join."""
    w = windows.select("text", "doc_id", "start", "known")
    total = w.groupBy("text").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last"))
    total = total.where("first <> last").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = w.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")).join(total, ["text", "salt"])
    if plan.keep_first:
        hit = hit.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    else:
        hit = hit.where(~F.col("known"))
    return hit.select("doc_id", "start", (F.col("start") + 1).alias("stop"))


def distinct(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(each different text's first row by document and start, all other rows) of (key, doc_id, start, count, known, bytes)."""
    first: dict[bytes, tuple] = {}
    others = []
    for row in sorted(rows, key=lambda r: r[1:3]):
        if row[5] in first:
            others.append(row)
        else:
            first[row[5]] = row
    return list(first.values()), others


def shared(rows: list[tuple]) -> list[tuple]:
    """The rows whose key others have too."""
    n = Counter(r[0] for r in rows)
    return [r for r in rows if n[r[0]] > 1]


def ranges(dealt: DataFrame, docs: DataFrame, plan: Plan, resolve) -> DataFrame:
    """Ranges of window starts whose windows are to be removed.

    ``resolve(plan)`` gives the function that a task applies to its open
    pieces: from a list of (key, doc_id, start, count, known, bytes) to the
    arrays doc_id, start, stop.
    """
    # dealt by key alone, both windows of judged() share one exchange and one sort
    found = scan(docs, plan).repartition(workdir.partitions(docs), "key")
    todo = workdir.written(judged(found, plan), "pieces")
    crowded = F.col("rivals") > plan.key_pieces
    windows = opened(dealt, todo.where(crowded), plan)  # of few documents
    solve = resolve(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).to_pydict()
            rows = {x[:3]: x for x in zip(t["key"], t["doc_id"], t["start"], t["count"], t["known"], t["text"], strict=True)}
            doc, start, stop = solve(list(rows.values()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["doc_id", "start", "stop"])

    spread = opened(dealt, todo.where(~crowded), plan).select("key", "doc_id", "start", "count", "known", "text").repartition(workdir.partitions(docs), "key")
    first, number = F.shiftright("place", 10), F.col("place").bitwiseAND(1023)
    gone = todo.where("state in ('gone', 'known')").select("doc_id", first.alias("start"), (first + number).alias("stop"))
    return gone.unionByName(spread.mapInArrow(run, RANGE)).unionByName(crowded_ranges(windows, plan))


def applied(dealt: DataFrame, found: DataFrame, finish, schema: str) -> DataFrame:
    """Joins each document with its ranges; ``finish(doc ids, data, offsets, ranges)`` gives a batch."""
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    both = dealt.join(per_doc.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.flat(batch.column(1))
            lists = batch.column(2)
            edges, values = lists.offsets.to_numpy(), lists.values
            start, stop = values.field("start").to_numpy(), values.field("stop").to_numpy()
            yield finish(batch.column(0), data, offsets, [(start[a:b], stop[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    return both.mapInArrow(run, schema)


def covered(starts: np.ndarray, stops: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols that windows with these starts cover."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for s, e in zip(starts[order].tolist(), (stops[order] - 1 + length).tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
