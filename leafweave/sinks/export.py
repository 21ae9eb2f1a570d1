"""Sinks: JSON, JSON lines, CSV, mind map, spreadsheet, coverage text, HTML report, Markdown files.

Large tables are written by Spark in parallel.  Exports of one project's tree
are single files in order; ``ordered`` streams their rows from one sorted range
at a time, so the driver holds a row, not the tree.
"""

from __future__ import annotations

import csv
import json
import re
import shutil
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from leafweave.operators import tree

# Column heads, widths and the wording of the coverage lines below.
HEADER = ("Code", "Title", "Level", "Type", "Work Items", "Source Pages")
WIDTHS = (12, 50, 8, 12, 12, 20)


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def purge(folder: str | Path, pattern: str = "*.json") -> int:
    """Removes a folder's files of a pattern before it is written anew; how many there were."""
    found = list(Path(folder).glob(pattern)) if Path(folder).is_dir() else []
    for path in found:
        shutil.rmtree(path) if path.is_dir() else path.unlink()
    return len(found)


def write_json(rows: DataFrame, path: str, lines: bool = True) -> None:
    """A folder of JSON lines in UTF-8, in parallel; or one file with an indented array, for small tables."""
    if lines:
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for k, row in enumerate(rows.toLocalIterator()):
            out.write(",\n" * bool(k) + ("\n" if not k else "") + _indented(row.asDict(recursive=True)))
        out.write("\n]")


def _indented(value: dict) -> str:
    return "\n".join("  " + x for x in json.dumps(value, ensure_ascii=False, indent=2, default=str).split("\n"))


def ordered(nodes: DataFrame) -> Iterator[Row]:
    """Nodes (ord, ...) one after the other."""
    return nodes.orderBy("ord").toLocalIterator()


def csv_rows(nodes: DataFrame) -> DataFrame:
    """ord and the columns of HEADER for nodes (ord, code, title, level, type, work_items, source_pages) below the root."""
    pages = F.array_join(F.transform(F.slice("source_pages", 1, 5), lambda p: p + 1), ",")
    n = F.size(F.coalesce("work_items", F.array().cast("array<string>")))
    columns = (F.col("code"), tree.indented(F.col("title"), (F.col("level") - 1).cast("int")), F.col("level"), F.col("type"), n, F.coalesce(pages, F.lit("")))
    return nodes.where("level > 0").select("ord", *[c.alias(h) for c, h in zip(columns, HEADER, strict=True)])


def write_csv(nodes: DataFrame, path: str) -> None:
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(HEADER)
        for row in ordered(csv_rows(nodes)):
            writer.writerow(row[1:])


def mermaid_rows(nodes: DataFrame) -> DataFrame:
    """(ord, line) of a mind map, the root first."""
    label = F.when(F.col("code") != "", F.concat("code", F.lit(" "), "title")).otherwise(F.col("title"))
    return nodes.where("level > 0").select("ord", tree.indented(F.translate(label, "()[]", ""), F.col("level").cast("int"), "    ").alias("line"))


def write_mermaid(nodes: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(["mindmap", "  root((WBS))"]))
        for row in ordered(mermaid_rows(nodes)):
            out.write("\n" + row["line"])


def _cell(column: int, row: int, value, bold: bool) -> str:
    at, style = f"{chr(65 + column)}{row}", ' s="1"' if bold else ""
    if isinstance(value, int):
        return f'<c r="{at}"{style}><v>{value}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value or ""))
    return f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def write_xlsx(nodes: DataFrame, path: str, sheet: str = "WBS") -> None:
    """The rows of the CSV as a spreadsheet: bold header and first level, fixed widths.  Needs no library."""

    def lines() -> Iterator[str]:
        yield f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><cols>'
        yield "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(WIDTHS, 1)) + "</cols><sheetData>"
        for k, values in enumerate(_with_header(ordered(csv_rows(nodes))), 1):
            bold = k == 1 or values[2] == 1
            yield f'<row r="{k}">' + "".join(_cell(c, k, v, bold) for c, v in enumerate(values)) + "</row>"
        yield "</sheetData></worksheet>"

    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{xml}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
        "_rels/.rels": f'{xml}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{xml}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            for text in lines():
                out.write(text.encode("utf-8"))


def _with_header(rows: Iterable[Row]) -> Iterator[tuple]:
    yield HEADER
    for row in rows:
        yield tuple(row[1:])


def coverage_lines(summary: Row, subdocs: DataFrame, n_sections: int, n_tables: int, n_nodes: int) -> list[str]:
    """Counts, then a line for each subdocument (ord, title, page_start, page_end, page_count, doc_type)."""
    counts = (("Total pages", summary["total_pages"]), ("Normal text", summary["normal"]), ("Image only", summary["image_only"]), ("Garbled text", summary["garbled"]))
    more = (("Subdocuments", subdocs.count()), ("Sections", n_sections), ("Tables (named)", n_tables), ("WBS nodes", n_nodes))
    line = lambda pair: f"{pair[0] + ':':15} {pair[1]}"
    own = F.format_string("  %s  p%d-p%d  (%dp)  [%s]", tree.padded(F.col("title"), 20), F.col("page_start") + 1, F.col("page_end") + 1, F.col("page_count"), F.col("doc_type"))
    rest = [r["line"] for r in ordered(subdocs.select("ord", own.alias("line")))]
    return ["=== WBS Coverage Report ===", "", *map(line, counts), "", *map(line, more), "", "Subdocument breakdown:", *rest]


def slim_items(items: DataFrame, sections: DataFrame) -> DataFrame:
    """(item_id, subdoc_id, category, slim) of items, with their section's title and pages counted from 1."""
    pages = F.array_sort(F.array_distinct(F.transform(F.coalesce("source_pages", F.array().cast("array<bigint>")), lambda p: p + 1)))
    titles = sections.select("section_id", F.col("title").alias("section_title"))
    rows = items.join(titles, "section_id", "left")
    slim = F.struct(F.col("item_id").alias("id"), F.col("description").alias("desc"), F.col("category").alias("cat"), pages.alias("pages"), F.coalesce("section_title", "section_id").alias("sec"))
    return rows.select("item_id", "subdoc_id", "category", slim.alias("slim"))


def payload(nodes: DataFrame, items: DataFrame, sections: DataFrame, subdocs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The report's nodes (ord, node), orphans (branch, items) and stats (one row).

    A node lists its items in order; ids that no item has are left out.  An
    item that no node has is an orphan of its subdocument's title.
    """
    slim = slim_items(items, sections)
    held = nodes.select("node_id", F.posexplode(F.coalesce("work_items", F.array().cast("array<string>"))).alias("k", "item_id"))
    own = held.join(slim, "item_id").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "slim"))), lambda x: x["slim"]).alias("items"))
    fields = [F.col("node_id").alias("id"), "code", "title", "level", F.col("parent_id").alias("parent")]
    none = F.array().cast(own.schema["items"].dataType)
    out = nodes.join(own, "node_id", "left").select("ord", F.struct(*fields, F.coalesce("items", none).alias("items")).alias("node"))
    attached = held.select("item_id").distinct()
    titles = subdocs.select("subdoc_id", F.col("title").alias("branch"))
    free = slim.join(attached, "item_id", "left_anti").join(titles, "subdoc_id", "left")
    orphans = free.groupBy(F.coalesce("branch", "subdoc_id").alias("branch")).agg(F.array_sort(F.collect_list("slim")).alias("items"))
    known = attached.join(items.select("item_id").distinct(), "item_id", "left_semi").agg(F.count("*").alias("attached"))
    stats = items.agg(F.count("*").alias("total_items")).crossJoin(known).crossJoin(nodes.agg(F.count("*").alias("nodes")))  # one row each
    return out, orphans, stats


def script_safe(text: str) -> str:
    """JSON that can stand in a script element."""
    return text.replace("</", "<\\/")


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}li{{margin:.2em 0}}small{{color:#666}}</style>
<h1>{title}</h1><p id="stats"></p><input id="find" placeholder="search"><ul id="tree"></ul><h2>Not attached</h2><ul id="rest"></ul>
<script>const data = {data};
const line = (list, text, small) => {{ const li = document.createElement("li"); li.textContent = text; if (small) {{ const s = document.createElement("small"); s.textContent = " " + small; li.append(s); }} list.append(li); }};
const show = word => {{ const has = i => !word || i.desc.toLowerCase().includes(word.toLowerCase()); tree.replaceChildren(); rest.replaceChildren();
 for (const n of data.nodes) {{ const items = n.items.filter(has); if (word && !items.length) continue; line(tree, "\\u2003".repeat(n.level) + n.code + " " + n.title); for (const i of items) line(tree, "\\u2003".repeat(n.level + 1) + i.desc, i.cat + " p" + i.pages.join(",")); }}
 for (const [branch, items] of Object.entries(data.orphans)) for (const i of items.filter(has)) line(rest, i.desc, branch + " " + i.cat); }};
const tree = document.getElementById("tree"), rest = document.getElementById("rest");
document.getElementById("stats").textContent = JSON.stringify(data.stats); document.getElementById("find").oninput = e => show(e.target.value); show("");
</script>"""


def write_html(nodes: DataFrame, items: DataFrame, sections: DataFrame, subdocs: DataFrame, meta: dict, path: str) -> None:
    """A report that stands alone: the tree with items, orphans by branch, counts, a search box."""
    found, orphans, stats = payload(nodes, items, sections, subdocs)
    data = {
        "meta": meta, "nodes": [r["node"].asDict(recursive=True) for r in ordered(found)],
        "orphans": {r["branch"]: [i.asDict(recursive=True) for i in r["items"]] for r in orphans.orderBy("branch").toLocalIterator()}, "stats": stats.first().asDict(),
    }
    Path(path).write_text(_PAGE.format(title=escape(str(meta.get("project", "WBS"))), data=script_safe(json.dumps(data, ensure_ascii=False))), encoding="utf-8")


def write_sections(markdown: DataFrame, folder: str) -> int:
    """One Markdown file a section (section, markdown), one after the other; how many."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for r in markdown.select("section", "markdown").toLocalIterator():
        (Path(folder) / f"{r['section']}.md").write_text(r["markdown"], encoding="utf-8")
        n += 1
    return n
