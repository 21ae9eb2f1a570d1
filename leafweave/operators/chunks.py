"""Greedy packing of text segments and table rows into pieces for a model.

Packing is a left fold inside the JVM; its state is the finished pieces and the
open one, which is no longer than the limit unless a single part is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafweave.functions import text as T

LIMIT = 2500
# Fixed value: a segment ends at a newline before an empty line, a heading, a table caption or a table row.
BREAK = rf"\n(?=\n|#{{1,4}}{T.WS}|表{T.WS}*\p{{Nd}}+|\|)"


def packed(parts: Column, limit: int) -> Column:
    """Parts joined by newlines into stripped pieces of at most ``limit`` characters, longer parts whole; blank pieces go."""
    none = F.array().cast("array<string>")

    def add(state: Column, part: Column) -> Column:
        now = state["now"]
        full = (F.length(now) + F.length(part) + 1 > limit) & (T.strip(now) != "")
        grown = F.when(full | (now == ""), part).otherwise(F.concat(now, F.lit("\n"), part))
        return F.struct(F.when(full, F.array_append(state["done"], T.strip(now))).otherwise(state["done"]).alias("done"), grown.alias("now"))

    def end(state: Column) -> Column:
        return F.when(T.strip(state["now"]) != "", F.array_append(state["done"], T.strip(state["now"]))).otherwise(state["done"])

    return F.aggregate(parts, F.struct(none.alias("done"), F.lit("").alias("now")), add, end)


def chunk_text(text: Column, limit: int = LIMIT) -> Column:
    """Pieces of a text: segments are packed first; pieces still too long are packed by lines.

    A text within the limit is its own piece, unstripped; null counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    segments = F.filter(F.split(text, BREAK, -1), lambda s: T.strip(s) != "")
    pieces = F.transform(packed(segments, limit), lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(packed(F.split(p, "\n", -1), limit)))
    found = F.flatten(pieces)
    return F.when(F.length(text) <= limit, F.array(text)).when(F.size(found) > 0, found).otherwise(F.array(F.substring(text, 1, limit)))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))


def row_lines(header: Column, rows: Column) -> Column:
    """Rows as Markdown lines, padded or cut to the header's width."""
    n = F.size(header)
    return F.transform(rows, lambda r: _line(F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), 1, n)))


def head_lines(header: Column) -> Column:
    return F.array(_line(header), _line(F.transform(header, lambda x: F.lit("---"))))


def markdown(header: Column, rows: Column) -> Column:
    """A table as Markdown; empty without a header."""
    table = F.concat(F.array_join(F.concat(head_lines(header), row_lines(header, F.coalesce(rows, F.array().cast("array<array<string>>")))), "\n"), F.lit("\n"))
    return F.when(F.size(header) > 0, table).otherwise("")


def chunk_table_rows(caption: Column, header: Column, rows: Column, limit: int = LIMIT) -> Column:
    """Pieces of a table, each with caption and header; none without a header or rows."""
    none = F.array().cast("array<string>")
    head = F.array_join(F.concat(F.when(caption != "", F.array(caption)).otherwise(none), head_lines(header)), "\n")

    def add(state: Column, line: Column) -> Column:
        now = state["now"]
        full = (now != "") & (F.length(head) + 1 + F.length(now) + F.length(line) + 1 > limit)
        lines = F.concat(F.when(full, "").otherwise(now), line, F.lit("\n"))
        return F.struct(F.when(full, F.array_append(state["done"], now)).otherwise(state["done"]).alias("done"), lines.alias("now"))

    def end(state: Column) -> Column:
        return F.transform(F.array_append(state["done"], state["now"]), lambda x: T.strip(F.concat(head, F.lit("\n"), x)))

    made = F.aggregate(row_lines(header, rows), F.struct(none.alias("done"), F.lit("").alias("now")), add, end)
    return F.when((F.size(header) > 0) & (F.size(rows) > 0), made).otherwise(none)
