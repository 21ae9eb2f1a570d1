"""Sources: JSON, JSON lines, folders of page files, settings, prompts and page decoders."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PROMPTS = Path(__file__).parent.parent / "prompts"
BLOCK = "doc string, page long, ord long, block_id string, x0 double, y0 double, x1 double, y1 double, height double, text string, font_name string, font_size double, is_bold boolean"

# Settings that a project has without a file.
DEFAULTS: dict[str, dict] = {
    "llm": {"base_url": "http://localhost:8000/v1", "model": "", "api_key": "", "temperature_wbs": 0.1, "max_retries": 3, "mock": True},
    "layout": {"header_band": 0.12, "footer_band": 0.12, "min_consecutive_pages": 2},
    "table": {"merge_confidence_min": 0.80},
}
SETTINGS = ("wbs.toml", "wbs.local.toml")


def json_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of whole-file JSON arrays or objects, with a declared schema; values that don't fit are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines give none."""
    return spark.read.schema(schema).json(path)


def folder_rows(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "p*.json") -> DataFrame:
    """Rows of a folder's whole-file JSON documents with ``file``, its name, which decides their order."""
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).json(folder, multiLine=True)
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).orderBy("file")


def settings(folder: str | Path, defaults: dict[str, dict] = DEFAULTS) -> dict[str, dict]:
    """Defaults, then the shared file's, then the machine's own values, section by section."""
    out = {k: dict(v) for k, v in defaults.items()}
    for name in SETTINGS:
        path = Path(folder) / name
        if path.exists():
            for section, values in tomllib.loads(path.read_text(encoding="utf-8")).items():
                out[section] = out.get(section, {}) | values
    return out


def prompt(name: str) -> str:
    """A prompt of that name and version, such as classify_v1."""
    return (PROMPTS / f"{name}.txt").read_text(encoding="utf-8")


def text_block(page: int, ord_: int, lines: Iterable[list[dict]], box: tuple, height: float) -> dict:
    """A block of a page's lines of spans (text, font, size, bold): their text without separators, the first span's font."""
    spans = [s for line in lines for s in line]
    first = spans[0] if spans else {"font": "", "size": 0.0, "bold": False}
    return {"page": page, "ord": ord_, "block_id": f"p{page + 1:04d}-b{ord_:03d}", "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "height": height, "text": "".join(s["text"] for s in spans), "font_name": first["font"], "font_size": float(first["size"]), "is_bold": bool(first["bold"])}


PAGE = "doc string, page long, width double, height double, image_count long, fonts array<struct<name:string,encoding:string,definition:string>>, blocks array<struct<kind:int,ord:long,x0:double,y0:double,x1:double,y1:double,lines:array<array<struct<text:string,font:string,size:double,bold:boolean>>>>>, tables array<array<array<string>>>"


def decoded(spark: SparkSession, path: str, decoder: Callable[[str, bytes], Iterable[dict]], partitions: int | None = None) -> DataFrame:
    """Pages (see PAGE) of binary documents, by a decoder of (name, bytes) to page dictionaries.

    The decoder is an adapter to whatever PDF library the cluster has; a file
    is decoded in one task, files in parallel.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content")
    files = files.repartition(partitions) if partitions else files
    columns = [x.split()[0] for x in PAGE.replace("<", " <").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc"], batch["content"], strict=True):
                pages = [{"doc": doc, **page} for page in decoder(doc, bytes(content))]
                yield pd.DataFrame(pages, columns=columns)

    return files.mapInPandas(run, PAGE)


def blocks_of(pages: DataFrame) -> DataFrame:
    """Text blocks (kind 0) of decoded pages: spans joined without a separator, the first span's font."""
    rows = pages.select("doc", "page", "height", F.explode("blocks").alias("b")).where("b.kind = 0")
    spans = F.flatten("b.lines")
    first = F.get(spans, F.lit(0))
    return rows.select(
        "doc", "page", F.col("b.ord").alias("ord"), F.format_string("p%04d-b%03d", F.col("page") + 1, F.col("b.ord")).alias("block_id"), "b.x0", "b.y0", "b.x1", "b.y1", "height",
        F.array_join(F.transform(spans, lambda s: s["text"]), "").alias("text"), F.coalesce(first["font"], F.lit("")).alias("font_name"), F.coalesce(first["size"], F.lit(0.0)).alias("font_size"), F.coalesce(first["bold"], F.lit(False)).alias("is_bold"),
    )


def page_facts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, image_count, char_count, fonts): characters but blanks and line ends, the page's distinct fonts in order."""
    found = blocks.groupBy("doc", "page").agg(F.sum(F.length(F.translate("text", " \n", ""))).alias("char_count"), F.array_sort(F.collect_set("font_name")).alias("fonts"))
    return pages.select("doc", "page", F.coalesce("image_count", F.lit(0)).alias("image_count")).join(found, ["doc", "page"], "left").withColumn("char_count", F.coalesce("char_count", F.lit(0))).withColumn("fonts", F.coalesce("fonts", F.array().cast("array<string>")))


def fonts_of(pages: DataFrame) -> DataFrame:
    """(doc, name, encoding, has_tounicode): a font as its first page defines it."""
    rows = pages.select("doc", "page", F.posexplode("fonts").alias("k", "f"))
    first = rows.groupBy("doc", F.col("f.name").alias("name")).agg(F.min_by("f", F.struct("page", "k")).alias("f"))
    return first.select("doc", "name", F.coalesce("f.encoding", F.lit("")).alias("encoding"), F.coalesce(F.col("f.definition").contains("/ToUnicode"), F.lit(False)).alias("has_tounicode"))


def tables_of(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, page, t, rows) of tables on wanted pages (doc, page), with clean cells."""
    from leafweave.operators.tables import clean_cells

    rows = pages.join(wanted.select("doc", "page").distinct(), ["doc", "page"], "left_semi").select("doc", "page", F.posexplode("tables").alias("t", "raw"))
    return rows.select("doc", "page", F.col("t").cast("long").alias("t"), F.transform("raw", clean_cells).alias("rows"))
