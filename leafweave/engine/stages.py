"""The fifteen stages, from decoded pages to exports, over any number of documents.

A stage is a function of a context to named DataFrames.  The context reads what
earlier stages wrote; the runner writes a stage's tables as Parquet below the
project's folder, so a later run can begin anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafweave.engine.manifest import STAGES
from leafweave.functions import text as T
from leafweave.model import client as model
from leafweave.operators import assemble, chunks, intervals, labels, layout, packages, quality, sections, segments, tables, tree, validate
from leafweave.sinks import export
from leafweave.sources import files

#: Document types whose sections and tables are looked for, and those that are never read for items.
SECTION_TYPES = ("REQUIREMENT_SPECIFICATION", "CONTRACT_BODY", "ATTACHMENT", "BID_INSTRUCTIONS", "EVALUATION_GUIDELINES")
UNREAD_TYPES = ("SERVICE_PROPOSAL", "SCANNED_PAGES")
_LETTER = {"NORMAL_TEXT": "N", "GARBLED_TEXT": "G", "EMPTY": "E", "IMAGE_ONLY": "I"}

CLASSIFY = {"type": "object", "properties": {"category": {"type": "string", "enum": list(sections.CATEGORIES)}, "confidence": {"type": "number"}, "reasoning": {"type": "string"}}}
EXTRACT = {"type": "object", "properties": {"work_items": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}, "description": {"type": "string"}, "category": {"type": "string", "enum": list(sections.CATEGORIES)}, "source_text": {"type": "string"}}}}}}
RELATE = {"type": "object", "properties": {"relations": {"type": "array", "items": {"type": "object", "properties": {"from": {"type": "string"}, "to": {"type": "string"}, "type": {"type": "string", "enum": ["depends_on", "part_of", "related_to", "precedes"]}}}}}}
LOCAL = {"type": "object", "properties": {"nodes": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}, "level": {"type": "integer"}, "children": {"type": "array", "items": {"type": "string"}}, "work_items": {"type": "array", "items": {"type": "string"}}}}}}}
ITEM = "array<struct<title:string,description:string,category:string,source_text:string>>"


@dataclass
class Context:
    spark: SparkSession
    folder: Path
    config: dict
    #: Decoded pages (see ``sources.files.PAGE``), for the first stage only.
    source: Callable[[], DataFrame] | None = None

    def path(self, stage: str, name: str) -> str:
        return str(self.folder / f"{STAGES.index(stage) + 1:02d}_{stage}" / f"{name}.parquet")

    def read(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, name))

    def client(self) -> model.Client:
        return model.Client.of(self.config)


Tables = dict[str, DataFrame]


def parse(c: Context) -> Tables:
    pages = c.source()
    blocks = files.blocks_of(pages)
    return {"pages": pages, "blocks": blocks, "facts": files.page_facts(pages, blocks), "fonts": files.fonts_of(pages)}


def page_quality(c: Context) -> Tables:
    blocks = c.read("parse", "blocks")
    text = blocks.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("text"))
    rows = c.read("parse", "facts").select("doc", "page", "image_count").join(text, ["doc", "page"], "left").withColumn("s", T.text_stats(F.col("text"))).select("doc", "page", "image_count", "s.*")
    first = quality.first_pass(rows)
    letter = F.create_map(*[F.lit(x) for kv in _LETTER.items() for x in kv])
    name = F.create_map(*[F.lit(x) for k, v in _LETTER.items() for x in (v, k)])
    settled = quality.resolve(first.select("doc", "page", F.element_at(letter, F.col("state")).alias("c")))
    out = rows.join(settled.select("doc", "page", F.element_at(name, F.col("after")).alias("quality")), ["doc", "page"])
    return {"pages": out, "summary": quality.summary(settled)}


def running_lines(c: Context) -> Tables:
    own = c.config.get("layout", {})
    normal = c.read("quality", "pages").where("quality = 'NORMAL_TEXT'").select("doc", "page")
    blocks = c.read("parse", "blocks")
    band = layout.band_candidates(blocks.join(normal, ["doc", "page"], "left_semi"), own.get("header_band", 0.12), own.get("footer_band", 0.12))
    found = layout.families(band, own.get("min_consecutive_pages", 2))
    held = layout.family_blocks(band, found)
    roles = held.groupBy("doc", "page", "ord").agg(F.min_by("role", "family").alias("role"))
    marked = blocks.join(roles, ["doc", "page", "ord"], "left").withColumn("role", F.coalesce("role", F.lit("BODY"))).withColumn("exclude", F.lit(False))
    return {"families": held, "blocks": marked}


def subdocuments(c: Context) -> Tables:
    pages = c.read("quality", "pages").select("doc", "page", "quality")
    blocks = c.read("parse", "blocks").select("doc", "page", "ord", "text", "font_size")
    held = c.read("layout", "families").select("doc", "family", "role", "pattern", "page").distinct()
    found = labels.page_labels(pages, blocks, held)
    runs = labels.titled(segments.run_length(found.select("doc", "page", "label")))
    return {"labels": found, "subdocs": runs.withColumn("subdoc_id", F.format_string("subdoc-%03d", "seq"))}


def contents(c: Context) -> Tables:
    return {"entries": sections.contents(c.read("subdoc", "subdocs"), c.read("parse", "blocks"))}


def section_list(c: Context) -> Tables:
    runs = c.read("subdoc", "subdocs").where(F.col("doc_type").isin(*SECTION_TYPES))
    normal = c.read("quality", "pages").where("quality = 'NORMAL_TEXT'").select("doc", "page")
    where = intervals.pages_of(runs).select("doc", "seq", "subdoc_id", "doc_type", F.col("end_page").alias("last_page"), "page").join(normal, ["doc", "page"], "left_semi")
    rows = where.join(sections.content_blocks(c.read("layout", "blocks")), ["doc", "page"]).withColumn("title", sections.title(F.col("doc_type"), F.col("text"), F.col("font_size"))).where("title is not null")
    w = Window.partitionBy("doc", "seq").orderBy("page", "ord")
    nxt = F.lead("page").over(w)
    end = F.when(nxt.isNull(), F.col("last_page")).when(nxt == F.col("page"), F.col("page")).otherwise(nxt - 1)
    found = rows.select("doc", "seq", "subdoc_id", "doc_type", "title", "ord", F.col("page").alias("start_page"), end.alias("end_page"), F.col("block_id").alias("start_block_id"), F.coalesce(F.lead("block_id").over(w), F.lit("")).alias("end_block_id"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("seq", "start_page", "ord"))
    return {"sections": found.withColumn("section", number.cast("long")).withColumn("section_id", F.format_string("%s-sec-%03d", "subdoc_id", "section")).drop("ord")}


def table_list(c: Context) -> Tables:
    runs = c.read("subdoc", "subdocs").where(F.col("doc_type").isin(*SECTION_TYPES))
    normal = c.read("quality", "pages").where("quality = 'NORMAL_TEXT'").select("doc", "page")
    wanted = intervals.pages_of(runs).select("doc", "page").join(normal, ["doc", "page"], "left_semi")
    fragments = files.tables_of(c.read("parse", "pages"), wanted)
    captions = c.read("parse", "blocks").join(wanted, ["doc", "page"], "left_semi").select("doc", "page", "ord", T.caption(F.col("text")).alias("caption"))
    found = tables.whole_tables(fragments, captions, c.config.get("table", {}).get("merge_confidence_min", 0.8))
    held = c.read("section", "sections").select("doc", F.col("section").alias("seq"), "start_page", "end_page")
    where = intervals.first_covering(found.select("doc", "table", F.col("page_start").alias("page")), held).select("doc", "table", "section")
    return {"fragments": fragments, "tables": found.join(where, ["doc", "table"])}


def assembled(c: Context) -> Tables:
    found = c.read("table", "tables").select("doc", "table", "page_start", "page_end", "caption", chunks.markdown(F.col("header"), F.col("rows")).alias("markdown"))
    out = assemble.sections(c.read("section", "sections").select("doc", "section", "title", "start_page", "end_page"), c.read("quality", "pages").select("doc", "page", "quality"), c.read("layout", "blocks"), found)
    return {"markdown": out}


def _clean(c: Context) -> DataFrame:
    """(doc, section, bad): whether a section touches a page that can't be read."""
    held = c.read("section", "sections")
    bad = c.read("quality", "pages").where(F.col("quality").isin("GARBLED_TEXT", "IMAGE_ONLY")).select("doc", "page")
    hit = intervals.pages_of(held).select("doc", "section", "page").join(bad, ["doc", "page"], "left_semi").select("doc", "section").distinct().withColumn("bad", F.lit(True))
    return held.join(hit, ["doc", "section"], "left").select("doc", "section", F.coalesce("bad", F.lit(False)).alias("bad"))


def classified(c: Context) -> Tables:
    rule = T.classify_title(F.col("title"))
    rows = c.read("section", "sections").withColumn("rule_category", rule).withColumn("p", sections.priority(F.col("doc_type"), F.col("rule_category")))
    rows = rows.join(c.read("assemble", "markdown"), ["doc", "section"], "left").join(_clean(c), ["doc", "section"])
    rows = rows.select("doc", "section", "section_id", "subdoc_id", "doc_type", "title", "rule_category", "p.priority", "p.relevance", "bad", "markdown")
    asked = rows.where(sections.asked(F.col("markdown"), F.col("bad"), F.col("priority"))).select("doc", "section", F.substring("markdown", 1, 2000).alias("user"))
    log = model.answers(asked, c.client(), files.prompt("classify_v1"), CLASSIFY)
    answer = log.select("doc", "section", F.get_json_object("output", "$.category").alias("answer"))
    out = rows.drop("markdown").join(answer, ["doc", "section"], "left").withColumn("category", sections.final_category(F.col("rule_category"), F.col("answer"))).drop("answer")
    return {"classes": out, "log": log.drop("user")}


def extracted(c: Context) -> Tables:
    """Items of table rows, then the model's, section by section; pieces that a model failed on are listed, not dropped in silence."""
    own = c.read("classify", "classes").where(~F.col("bad") & (F.col("priority") != "EXCLUDED") & ~F.col("doc_type").isin(*UNREAD_TYPES))
    spans = c.read("section", "sections").select("doc", "section", "start_page", "end_page")
    text = c.read("assemble", "markdown").where(T.strip(F.col("markdown")) != "")
    own = own.join(text.select("doc", "section", "markdown"), ["doc", "section"]).join(spans, ["doc", "section"])
    cells = F.substring(F.array_join(F.filter("row", lambda x: x != ""), " | "), 1, 300)
    rows = c.read("table", "tables").select("doc", "section", "table", "page_start", F.posexplode("rows").alias("k", "row"))
    one = own.select("doc", "section", "section_id", "subdoc_id", "category").join(rows, ["doc", "section"]).select("doc", "section", "section_id", "subdoc_id", F.format_string("tbl-%03d", "table").alias("table_id"), cells.alias("description"), "category", F.array(F.col("page_start")).alias("source_pages"), cells.alias("source_text"), F.lit(0).alias("kind"), F.col("table").alias("k1"), F.col("k").cast("long").alias("k2"))
    pieces = own.select("doc", "section", "section_id", "subdoc_id", "category", "start_page", "end_page", F.posexplode(chunks.chunk_text(F.col("markdown"))).alias("chunk", "user"))
    log = model.answers(pieces, c.client(), files.prompt("extract_v1"), EXTRACT, field="work_items")
    held = log.select("*", F.posexplode(F.from_json("output", ITEM)).alias("k", "i"))
    said = F.coalesce("i.title", "i.description", F.lit(""))
    two = held.select("doc", "section", "section_id", "subdoc_id", F.lit("").alias("table_id"), F.substring(said, 1, 300).alias("description"), sections.item_category(F.col("i.category"), F.col("category")).alias("category"), F.sequence("start_page", "end_page").alias("source_pages"), F.substring(F.coalesce("i.source_text", F.lit("")), 1, 500).alias("source_text"), F.lit(1).alias("kind"), F.col("chunk").cast("long").alias("k1"), F.col("k").cast("long").alias("k2"))
    every = one.unionByName(two).withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("section", "kind", "k1", "k2")).cast("long"))
    lost = log.where("error is not null").select("doc", "section_id", "chunk", F.length("user").alias("chunk_len"), F.lit("LLM_FAILED").alias("reason"), "error")
    return {"items": every.withColumn("item_id", F.format_string("item-%04d", "ord")).drop("kind", "k1", "k2"), "unextracted": lost, "log": log.drop("user", "output")}


def related(c: Context) -> Tables:
    own = c.read("extract", "items").select(F.struct("doc", "section").alias("section"), "ord", "item_id", "description")
    prompts = sections.relation_prompts(own).select("section.doc", "section.section", F.col("prompt").alias("user"))
    log = model.answers(prompts, c.client(), files.prompt("relate_v1"), RELATE)
    kind = "array<struct<`from`:string,`to`:string,type:string>>"
    edges = log.select("doc", "section", F.posexplode(F.from_json(F.get_json_object("output", "$.relations"), kind)).alias("k", "r"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("section", "k"))
    return {"relations": edges.select("doc", F.format_string("rel-%04d", number).alias("relation_id"), F.col("r.from").alias("from_item"), F.col("r.to").alias("to_item"), F.col("r.type").alias("relation_type"))}


def local_trees(c: Context) -> Tables:
    """A tree for each subdocument with items: the model's nodes, or else a node for each section and for its first twenty items."""
    own = c.read("classify", "classes").select("doc", "section", "priority", F.col("title").alias("section_title"))
    items = c.read("extract", "items").join(own, ["doc", "section"]).where("priority <> 'EXCLUDED'")
    titles = c.read("subdoc", "subdocs").select("doc", F.col("subdoc_id").alias("subdoc"), "title")
    line = F.concat(F.lit("- ["), "item_id", F.lit("] "), F.substring("description", 1, 100))
    per = items.groupBy("doc", F.col("subdoc_id").alias("subdoc"), "section", "section_title").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    part = F.concat(F.lit("\n## "), "section_title", F.lit("\n"), F.array_join("l.line", "\n"))
    prompts = per.groupBy("doc", "subdoc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", part.alias("part")))), lambda x: x["part"]), "\n").alias("text"))
    pieces = prompts.select("doc", "subdoc", F.posexplode(chunks.chunk_text(F.col("text"))).alias("chunk", "user"))
    log = model.answers(pieces, c.client(), files.prompt("localwbs_v1"), LOCAL, temperature=c.config.get("llm", {}).get("temperature_wbs", 0.1))
    kind = "array<struct<title:string,children:array<string>,work_items:array<string>>>"
    answered = log.withColumn("nodes", F.from_json(F.get_json_object("output", "$.nodes"), kind)).where(F.size("nodes") > 0)
    last = answered.groupBy("doc", "subdoc").agg(F.max_by("nodes", "chunk").alias("nodes"))  # a later piece's answer takes the place of an earlier one's
    found = packages.usable(last.select("doc", "subdoc", F.posexplode("nodes").alias("pos", "n")).select("doc", "subdoc", "pos", "n.*"))
    made = packages.from_nodes(found, titles).withColumn("source_pages", F.array().cast("array<bigint>"))
    rest = items.withColumnRenamed("subdoc_id", "subdoc").join(found.select("doc", "subdoc").distinct(), ["doc", "subdoc"], "left_anti")
    spans = c.read("section", "sections").select("doc", "section", "start_page", "end_page")
    return {"nodes": made.drop("ord").unionByName(_rule_tree(rest, spans, titles)), "log": log.drop("user", "output")}


def _rule_tree(items: DataFrame, spans: DataFrame, titles: DataFrame, most: int = 20) -> DataFrame:
    key, none = ["doc", "subdoc"], F.array().cast("array<bigint>")
    at = lambda level, section, item: F.struct(F.lit(level).alias("level"), section.alias("section"), item.alias("item"))
    empty = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    root = titles.join(items.select(*key).distinct(), key, "left_semi").select(*key, at(1, zero, zero).alias("at"), "title", empty.alias("work_items"), none.alias("source_pages"))
    two = items.groupBy(*key, "section", "section_title").agg(F.array_sort(F.collect_list(F.struct("ord", "item_id"))).alias("l")).join(spans, ["doc", "section"])
    two = two.select(*key, at(2, F.col("section"), zero).alias("at"), F.col("section_title").alias("title"), F.col("l.item_id").alias("work_items"), F.sequence("start_page", "end_page").alias("source_pages"))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("doc", "section").orderBy("ord"))).where(F.col("r") <= most)
    three = ranked.select(*key, at(3, F.col("section"), F.col("ord")).alias("at"), F.substring("description", 1, 100).alias("title"), F.array("item_id").alias("work_items"), "source_pages")
    every = root.unionByName(two).unionByName(three)
    order = Window.partitionBy("doc").orderBy("subdoc", "at.section", "at.item")
    within = order.rowsBetween(Window.unboundedPreceding, 0)
    above = lambda level: F.last(F.when(F.col("at.level") == level, F.col("node")), ignorenulls=True).over(within)
    rows = every.withColumn("node", F.concat(F.lit("rule-"), F.row_number().over(order)))
    parent = F.when(F.col("at.level") == 1, "").when(F.col("at.level") == 2, above(1)).otherwise(above(2))
    return rows.select(*key, "node", "title", F.col("at.level").cast("long").alias("level"), parent.alias("parent"), "work_items", F.lit("EXPLICIT").alias("type"), "source_pages")


def merged(c: Context) -> Tables:
    local = c.read("localwbs", "nodes").withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("subdoc", "level", F.length("node"), "node")).cast("long"))
    before = Path(c.path("merge", "kept"))
    kept = c.spark.read.parquet(str(before)) if before.exists() else c.spark.createDataFrame([], "doc string, node string, parent string, title string, code string")
    out = tree.merged(local.select("doc", "node", "parent", "ord", "title"), kept)
    facts = local.select("doc", "node", "subdoc", "ord", "type", "work_items", "source_pages")
    rows = out.join(facts, ["doc", "node"], "left").withColumn("type", F.when(F.col("origin") == "kept", "MANUAL").otherwise(F.coalesce("type", F.lit("INFERRED"))))
    order = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("origin") != "merged", F.coalesce("ord", F.lit(0))))
    return {"nodes": rows.withColumn("ord", order.cast("long")).withColumn("level", F.coalesce("level", F.lit(1).cast("long")))}


def validated(c: Context) -> Tables:
    found = validate.issues(c.read("merge", "nodes"), c.read("quality", "pages"))
    return {"issues": found, "report": validate.report(found)}


def exported(c: Context) -> Tables:
    """All formats, one set for the project; nothing but small files are written by the driver, row by row."""
    nodes = c.read("merge", "nodes").withColumnsRenamed({"node": "node_id", "parent": "parent_id"})
    subdocs = c.read("subdoc", "subdocs").select("subdoc_id", F.col("seq").alias("ord"), "title", F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"), F.col("n_pages").alias("page_count"), "doc_type")
    held = c.read("section", "sections")
    folder = c.folder / "exports"
    folder.mkdir(parents=True, exist_ok=True)
    base = str(folder / f"wbs_v1_{export.stamp()}")
    export.write_json(nodes.orderBy("ord"), base + ".json", lines=False)
    export.write_csv(nodes, base + ".csv")
    export.write_mermaid(nodes, base + ".mmd")
    export.write_xlsx(nodes, base + ".xlsx")
    summary = c.read("quality", "summary").first()
    named = c.read("table", "tables").where(F.col("caption").rlike(r"表\s*\p{Nd}+")).count()
    lines = export.coverage_lines(summary, subdocs, held.count(), named, nodes.where("level > 0").count())
    (folder / "coverage.txt").write_text("\n".join(lines), encoding="utf-8")
    meta = {"project": c.folder.name, "total_pages": summary["total_pages"], "garbled_pages": summary["garbled"], "image_pages": summary["image_only"], "mode": "mock" if c.client().mock else "real"}
    export.write_html(nodes, c.read("extract", "items"), held, subdocs, meta, base + ".html")
    export.write_sections(c.read("assemble", "markdown").join(held.select("doc", "section", "section_id"), ["doc", "section"]).select(F.col("section_id").alias("section"), "markdown"), str(folder / "sections"))
    return {}


RUNNERS: dict[str, Callable[[Context], Tables]] = dict(zip(STAGES, (parse, page_quality, running_lines, subdocuments, contents, section_list, table_list, assembled, classified, extracted, related, local_trees, merged, validated, exported), strict=True))


def run(c: Context, stage: str) -> bool:
    """Runs a stage and writes its tables; true if its result needs review."""
    for name, rows in RUNNERS[stage](c).items():
        rows.write.mode("overwrite").parquet(c.path(stage, name))
    return stage == "validate" and c.read("validate", "report").first()["needs_review"] > 0
