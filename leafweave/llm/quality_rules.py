"""Quality rules and distribution divergence.

A document fails if it is too short or repeats itself, or if its characters or
common words are distributed unlike its language: the Jensen-Shannon distance
between its histogram and the language's reference is too large.  References
are means over all documents of the language that pass the base rules, each
document counting once.  Histograms of short documents say little, so each
test has a least length below which it abstains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import textkit as tk
from leafweave.llm import workdir

# The most common function words of each language.
COMMON = {
    "en": "the of and to in a is that for it with as was on be by are this from at or an not have but",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au il ne pas plus avec se ce",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
LANGUAGES = tuple(COMMON)
N_COMMON = 25
#: Character classes, in this order, counted in words only.
CLASSES = ("lower", "upper", "digit", "punctuation", "symbol", "other")
#: Largest Jensen-Shannon distances (base 2, 0 to 1) that pass, and the words from which they are judged.
MAX_CLASS_DISTANCE = 0.30
MIN_CLASS_WORDS = 20
MAX_COMMON_DISTANCE = 0.20
MIN_COMMON_WORDS = 80
#: Few words scatter more: the limit is never below the first number plus the second over the root of the words.
COMMON_SCATTER = (0.11, 1.7)

_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[0x21:0x7F] = 4
_CLASS[[ord(c) for c in ".,;:'\"?!()-"]] = 3
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _repeated_words(prefix: tk.Prefix, limits: np.ndarray, window: int = 5) -> np.ndarray:
    """For each row, its words in windows of five words that the row has twice or more."""
    n, rows = len(prefix.sums) - 1, len(limits) - 1
    if n < window:
        return np.zeros(rows, dtype=np.int64)
    start = np.arange(n - window + 1)
    row = np.searchsorted(limits, start, side="right") - 1
    ok = start + window <= limits[row + 1]
    start, row = start[ok], row[ok]
    hashes = prefix.hash(start, start + window)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    alike = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(start), dtype=bool)
    twice[order[1:]] |= alike
    twice[order[:-1]] |= alike
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, start[twice], 1)
    np.add.at(marks, start[twice] + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return inside[limits[1:]] - inside[limits[:-1]]


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


_word_keys: dict[str, np.ndarray] = {}


def _keys(lang: str) -> np.ndarray:
    if lang not in _word_keys:
        words = [w.encode() for w in COMMON[lang].split()]
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        s, e, _ = tk.words(data, np.array([0, len(data)]))
        _word_keys[lang] = tk.Prefix.of_bytes(data).hash(s, e)
    return _word_keys[lang]


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang and all counts of every whole text; null counts as empty, an unknown language has no common words."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.flat(batch.column(1))
            langs = batch.column(2).to_pylist()
            for lo, hi in tk.slices(offsets):
                own, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                yield _measured(batch.column(0).slice(lo, hi - lo), own, offs, langs[lo:hi])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, f"doc_id long, lang string, {FEATURES}")


def _measured(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, langs: list) -> pa.RecordBatch:
    rows = len(langs)
    starts, ends, before = tk.words(data, offsets)
    inside = ~tk.IS_SPACE[data]
    point = (data & 0xC0) != 0x80
    prefix = tk.Prefix.of_bytes(data)
    stop = np.minimum(ends, starts + tk.Prefix.LONGEST)
    words = tk.Prefix(prefix.hash(starts, stop) ^ tk.mix((ends - starts).astype(np.uint64)))
    lower = tk.Prefix.of_bytes(_LOWER[data]).hash(starts, stop)
    kind = _CLASS[data]
    counted = inside & point
    classes = np.stack([_sums(counted & (kind == k), offsets) for k in range(len(CLASSES))], axis=1)
    common = np.zeros((rows, N_COMMON), dtype=np.int32)
    by = np.repeat(np.array([LANGUAGES.index(x) if x in COMMON else -1 for x in langs]), np.diff(before))
    row = np.repeat(np.arange(rows), np.diff(before))
    for k, lang in enumerate(LANGUAGES):
        at = np.flatnonzero(by == k)
        keys = _keys(lang)
        order = np.argsort(keys)
        slot = np.minimum(np.searchsorted(keys[order], lower[at]), len(keys) - 1)
        hit = keys[order][slot] == lower[at]
        common += np.bincount(row[at[hit]] * N_COMMON + order[slot[hit]], minlength=rows * N_COMMON).reshape(rows, N_COMMON).astype(np.int32)
    lines = [_duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def arrays(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int32)))

    return pa.RecordBatch.from_arrays(
        [ids, pa.array(langs, pa.string()), pa.array(np.diff(before)), pa.array(_sums(counted, offsets)), pa.array(_sums(_SYMBOL[data], offsets)), pa.array(lines, pa.int64()), pa.array(_repeated_words(words, before)), arrays(classes), arrays(common)],
        ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"],
    )


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def _share(column: str, k: int, total) -> F.Column:
    return F.col(column)[k] / total


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms by language (as many rows as there are known languages)."""
    chars, hits = F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_words")
    sums = [F.avg(_share("classes", k, chars)).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.avg(_share("common", k, hits)).alias(f"w{k}") for k in range(N_COMMON)]
    good = measured.where(~base_failed() & F.col("lang").isin(*LANGUAGES) & (F.col("n_words") >= MIN_CLASS_WORDS))
    out = {}
    for r in good.groupBy("lang").agg(*sums).collect():
        words = [r[f"w{k}"] for k in range(N_COMMON)]
        out[r["lang"]] = ([r[f"c{k}"] for k in range(len(CLASSES))], [*words, max(0.0, 1 - sum(words))])
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in base 2 of each row of ``p`` to ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def distances(batch: pa.RecordBatch, means: dict[str, tuple[list[float], list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of measured rows to their language, of classes and common words; NaN where the test abstains."""
    langs = np.array(batch.column("lang").to_pylist(), dtype=object)
    n_words = np.asarray(batch.column("n_words"))
    classes = np.asarray(batch.column("classes").flatten()).reshape(-1, len(CLASSES)).astype(float)
    common = np.asarray(batch.column("common").flatten()).reshape(-1, N_COMMON).astype(float)
    one, two = np.full(len(langs), np.nan), np.full(len(langs), np.nan)
    for lang, (c, w) in means.items():
        at = np.flatnonzero((langs == lang) & (n_words >= MIN_CLASS_WORDS))
        if len(at):
            one[at] = js_distance(classes[at] / classes[at].sum(axis=1, keepdims=True).clip(1), np.array(c))
        at = at[n_words[at] >= MIN_COMMON_WORDS]
        if len(at):
            shares = common[at] / n_words[at, None]
            two[at] = js_distance(np.column_stack([shares, 1 - shares.sum(axis=1)]), np.array(w))
    return one, two


def common_limit(n_words: np.ndarray) -> np.ndarray:
    """Largest distance of common words that passes, by the number of words."""
    base, scatter = COMMON_SCATTER
    return np.maximum(MAX_COMMON_DISTANCE, base + scatter / np.sqrt(np.maximum(n_words, 1)))


def judged(measured: DataFrame, means: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Adds class_distance and common_distance (null where the test abstains), base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = distances(batch, means)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one, from_pandas=True), pa.array(two, from_pandas=True)], [*batch.schema.names, "class_distance", "common_distance"])

    far = measured.mapInArrow(run, f"doc_id long, lang string, {FEATURES}, class_distance double, common_distance double")
    base, scatter = COMMON_SCATTER
    limit = F.greatest(F.lit(MAX_COMMON_DISTANCE), F.lit(base) + F.lit(scatter) / F.sqrt(F.greatest("n_words", F.lit(1))))
    unlike = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("common_distance", F.lit(0.0)) > limit)
    return far.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~unlike).drop("classes", "common")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document.

    A null or empty text has no words and fails.  A document whose language is
    null, unknown or without a reference is judged by the base rules alone.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    measured = workdir.cut(measure(docs, id_col, text_col, lang_col))
    return judged(measured, references(measured))


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` (all columns) that pass; texts are measured twice and never shuffled."""
    numbered = docs.select(F.lit(0).alias("doc_id"), *[c for c in (text_col, lang_col) if c in docs.columns])
    means = references(measure(numbered, "doc_id", text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            at = batch.schema.get_field_index(lang_col)
            langs = batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows
            data, offsets = tk.flat(text)
            keep = []
            for lo, hi in tk.slices(offsets):
                m = _measured(pa.nulls(hi - lo, pa.int64()), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], langs[lo:hi])
                one, two = distances(m, means)
                n, again = np.asarray(m.column("n_words")), np.asarray(m.column("n_repeat_words"))
                failed = (n < 10) | (100 * again > 20 * n)
                keep.append(~failed & ~(np.nan_to_num(one) > MAX_CLASS_DISTANCE) & ~(np.nan_to_num(two) > common_limit(n)))
            yield batch.filter(pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the whole table."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))

