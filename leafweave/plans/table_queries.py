"""Queries of intervals, tables, headings and stage records."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators import intervals, segments, tables
from leafweave.plans.register import PS, STRIP, V1, page_states, query, table, text_blocks

SEG = f"""{PS}, rl AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY doc ORDER BY page) = c THEN 0 ELSE 1 END AS new FROM ps), rs AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY page) AS seq FROM rl),
 seg AS (SELECT doc, seq::BIGINT AS seq, c AS label, min(page) AS start_page, max(page) AS end_page FROM rs GROUP BY doc, seq, c)"""


def runs(spark, d):
    return segments.run_length(page_states(spark, d).withColumnRenamed("c", "label")).drop("n_pages")


# intervals --------------------------------------------------------------------


@query(f"WITH {SEG} SELECT ps.doc, ps.page, seg.seq FROM ps JOIN seg ON ps.doc = seg.doc AND ps.page BETWEEN seg.start_page AND seg.end_page")
def subdoc_pages(spark, d):
    return intervals.pages_of(runs(spark, d)).select("doc", "page", "seq")


@query(f"WITH {SEG} SELECT doc, seq, start_page + k AS page FROM seg, range(8) r(k) WHERE start_page + k <= end_page")
def toc_scan_pages(spark, d):
    return intervals.pages_of(runs(spark, d), at_most=8).select("doc", "seq", "page")


@query(f"WITH {SEG} SELECT ps.doc, ps.page, coalesce((SELECT min(seq) FROM seg WHERE seg.doc = ps.doc AND seg.label <> 'E' AND ps.page BETWEEN seg.start_page AND seg.end_page + 1), -1) AS section FROM ps WHERE ps.page % 3 = 0")
def assign_table_section(spark, d):
    sections = runs(spark, d).where("label <> 'E'").withColumn("end_page", F.col("end_page") + 1)
    return intervals.first_covering(page_states(spark, d).where("page % 3 = 0").select("doc", "page"), sections).select("doc", "page", "section")


@query(f"WITH {PS}, s AS (SELECT doc, page AS seq, page AS start_page, page + 2 AS end_page FROM ps WHERE c = 'N') SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.doc = s.doc AND ps.page BETWEEN s.start_page AND s.end_page AND ps.c IN ('G', 'I'))")
def sections_clean_only(spark, d):
    pages = page_states(spark, d)
    sections = pages.where("c = 'N'").select("doc", F.col("page").alias("seq"), F.col("page").alias("start_page"), (F.col("page") + 2).alias("end_page"))
    return intervals.clean_only(sections, pages)


@query(f"WITH {PS}, a AS (SELECT doc, min(page) AS a FROM ps WHERE c = 'G' GROUP BY doc), b AS (SELECT ps.doc, min(page) AS b FROM ps JOIN a ON a.doc = ps.doc WHERE c = 'N' AND page > a.a GROUP BY ps.doc) SELECT ps.doc, ps.page, ps.c FROM ps JOIN a ON a.doc = ps.doc LEFT JOIN b ON b.doc = ps.doc WHERE ps.page >= a.a AND ps.page < coalesce(b.b, ps.page + 1)")
def label_extend(spark, d):
    return intervals.extend(page_states(spark, d), "G", "N")


@query(f"WITH {SEG} SELECT doc, seq, label FROM seg WHERE label IN ('N', 'G')")
def filter_doc_types(spark, d):
    return runs(spark, d).where(F.col("label").isin("N", "G")).select("doc", "seq", "label")


@query("SELECT event_date AS page, count(DISTINCT user_id) AS n_tables FROM (SELECT user_id, unnest(generate_series(CAST(min(epoch(date_trunc('day', ts)) / 86400) AS BIGINT), CAST(max(epoch(date_trunc('day', ts)) / 86400) AS BIGINT))) AS event_date FROM events GROUP BY user_id) GROUP BY 1")
def page_tables(spark, d):
    page = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    spans = table(spark, d, "events").groupBy("user_id").agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"))
    return intervals.pages_of(spans).groupBy("page").agg(F.count("*").alias("n_tables"))  # one span a user


# tables -----------------------------------------------------------------------


@query("SELECT p_partkey, array_to_string(list_transform(list_filter([p_name, '', p_brand, p_type], lambda x: x <> ''), lambda x: regexp_replace(x, '[\\s\\p{Z}]+', '', 'g')), '|') AS signature FROM part")
def column_signature(spark, d):
    return table(spark, d, "part").select("p_partkey", tables.column_signature(F.array("p_name", F.lit(""), "p_brand", "p_type")).alias("signature"))


@query(f"SELECT doc_id, {STRIP} || '|' || lang || '|' AS cells FROM documents")
def clean_cells(spark, d):
    row = F.array("text", F.concat(F.lit("  "), "lang", F.lit("\t")), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(tables.clean_cells(row), "|").alias("cells"))


@query("SELECT c_custkey, left(c_name || ' | ' || c_mktsegment, 300) AS description FROM customer")
def items_from_table_rows(spark, d):
    return table(spark, d, "customer").select("c_custkey", tables.row_text(F.array("c_name", F.lit(""), "c_mktsegment")).alias("description"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS cells FROM lineitem), h AS (SELECT l_orderkey, arg_min(cells, (l_linenumber, cells)) AS header FROM r GROUP BY 1) SELECT h.l_orderkey AS \"table\", header, coalesce(string_agg(cells, ',' ORDER BY l_linenumber, cells) FILTER (cells <> header), '') AS rows FROM h JOIN r ON r.l_orderkey = h.l_orderkey GROUP BY ALL")
def merge_table_rows(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("cells"))
    return tables.merge_rows(rows).withColumn("rows", F.array_join("rows", ","))


@query("SELECT l_orderkey AS \"table\", CASE WHEN count(*) = 1 THEN 1.0 WHEN count(DISTINCT l_returnflag) = 1 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence, count(*) > 1 AND count(DISTINCT l_returnflag) > 1 AS needs_review FROM lineitem GROUP BY 1")
def table_confidence(spark, d):
    return tables.confidence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_returnflag").alias("signature")))


@query(f"WITH {V1} SELECT doc, page, arg_min(text, ord) AS caption FROM tb WHERE length(text) BETWEEN 1 AND 40 GROUP BY doc, page")
def first_caption_per_page(spark, d):
    return text_blocks(spark, d).where("length(text) between 1 and 40").groupBy("doc", "page").agg(F.min_by("text", "ord").alias("caption"))


# blocks and headings ----------------------------------------------------------


@query(f"WITH {V1} SELECT doc, ord, page, y0, text FROM tb")
def parse_blocks(spark, d):
    return text_blocks(spark, d).select("doc", "ord", "page", "y0", "text")


@query(f"WITH {V1} SELECT doc, font_size::DOUBLE AS font_size, min(ord) AS ord FROM tb GROUP BY ALL")
def font_first_seen(spark, d):
    return text_blocks(spark, d).groupBy("doc", "font_size").agg(F.min("ord").alias("ord"))


@query(f"WITH {V1} SELECT doc, ord, page AS page FROM tb")
def block_id_page(spark, d):
    """From ids, which count pages from 1, back to pages from 0."""
    ids = text_blocks(spark, d).select("doc", "ord", F.format_string("p%04d-b%03d", F.col("page") + 1, F.col("ord") % 10).alias("block_id"))
    return ids.select("doc", "ord", (F.regexp_extract("block_id", r"p(\d+)-", 1).cast("long") - 1).alias("page"))


@query(f"WITH {V1} SELECT doc, ord FROM tb WHERE NOT contains(text, '....') AND NOT contains(text, '…')")
def reject_toc_lines(spark, d):
    return text_blocks(spark, d).where(~T.toc_like(F.col("text"))).select("doc", "ord")


@query(rf"WITH {V1} SELECT doc, ord, regexp_replace(text, '\s+\d+\s*$', '') AS rest, regexp_extract(text, '\s+(\d+)\s*$', 1) AS number FROM tb")
def strip_page_number(spark, d):
    at = r"[ \t\n\f\r]+([0-9]+)[ \t\n\f\r]*\z"
    return text_blocks(spark, d).select("doc", "ord", F.regexp_replace("text", at, "").alias("rest"), F.regexp_extract("text", at, 1).alias("number"))
