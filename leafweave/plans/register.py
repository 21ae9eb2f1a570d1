"""Register of the engine's queries and their SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators import layout, quality, segments

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# views ----------------------------------------------------------------------


def page_states(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", "quality")
    c = F.when(F.col("quality") == 1, "N").when(F.col("quality") == 0, "G").when(F.col("doc_id") % 2 == 0, "E").otherwise("I")
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    return docs.join(labels, "doc_id", "left").select(F.col("source").alias("doc"), page.alias("page"), c.alias("c"))


PS = """ps AS (SELECT d.source AS doc, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS page,
 CASE WHEN l.quality = 1 THEN 'N' WHEN l.quality = 0 THEN 'G' WHEN d.doc_id % 2 = 0 THEN 'E' ELSE 'I' END AS c
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
RESOLVED = f"""WITH RECURSIVE {PS}, nx AS (SELECT doc, page, c, coalesce(first(CASE WHEN c IN ('N','G') THEN c END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS n FROM ps),
 fold AS (SELECT doc, CAST(-1 AS BIGINT) AS page, '' AS c, '' AS acc FROM (SELECT DISTINCT doc FROM ps)
 UNION ALL SELECT f.doc, x.page, x.c, f.acc || CASE
  WHEN x.c = 'E' THEN CASE WHEN (p.v = 'G' AND x.n IN ('G','')) OR (x.n = 'G' AND p.v = '') THEN 'G' ELSE 'N' END
  WHEN x.c = 'I' AND (p.v = 'G' OR x.n = 'G') THEN 'G' ELSE x.c END
 FROM fold f JOIN nx x ON x.doc = f.doc AND x.page = f.page + 1, LATERAL (SELECT right(regexp_replace(right(f.acc, 5), '[^NG]', '', 'g'), 1) AS v) p),
 res AS (SELECT doc, page, c AS before, right(acc, 1) AS after FROM fold WHERE page >= 0)"""


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")))
    return lines.select(F.col("doc_id").alias("doc"), F.col("pos").cast("long").alias("ord"), F.floor(F.col("pos") / 10).cast("long").alias("page"), ((F.col("pos") % 10) * 80).cast("double").alias("y0"), F.lit(800.0).alias("height"), F.col("col").alias("text"), F.when(F.length("col") <= 40, 16.0).otherwise(11.0).alias("font_size"))


V1 = """tb AS (SELECT doc_id AS doc, ord, ord // 10 AS page, CAST((ord % 10) * 80 AS DOUBLE) AS y0, 800.0::DOUBLE AS height, text, CASE WHEN length(text) <= 40 THEN 16.0 ELSE 11.0 END AS font_size
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents))"""
STRIP = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '\p{Nd}+', '{n}', 'g'), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')"


FAM = f"""{V1}, cand AS (SELECT doc, page, CASE WHEN y0 < 96 THEN 'RUNNING_HEADER' ELSE 'RUNNING_FOOTER' END AS role, {NORM} AS pattern FROM tb WHERE (y0 < 96 OR y0 > 704) AND length({STRIP}) > 0),
 pp AS (SELECT doc, role, pattern, page, count(*) AS n FROM cand WHERE length(pattern) >= 2 GROUP BY ALL),
 rr AS (SELECT *, sum(n) OVER (PARTITION BY doc, role, pattern) AS total, page - row_number() OVER (PARTITION BY doc, role, pattern ORDER BY page) AS island FROM pp),
 fam AS (SELECT doc, role, pattern, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM rr WHERE total >= 2 GROUP BY doc, role, pattern, island HAVING count(*) >= 2)"""


# quality --------------------------------------------------------------------


@query(f"{RESOLVED} SELECT doc, page, before, after FROM res")
def quality_resolve(spark, d):
    return quality.resolve(page_states(spark, d))


@query(f"{RESOLVED} SELECT count(*) AS total_pages, count(*) FILTER (after = 'N') AS normal, count(*) FILTER (after = 'G') AS garbled, count(*) FILTER (after = 'I') AS image_only, count(*) FILTER (after = 'E') AS \"empty\" FROM res")
def quality_summary(spark, d):
    return quality.summary(quality.resolve(page_states(spark, d)))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'IMAGE_ONLY' ELSE 'EMPTY' END WHEN length(regexp_replace(text, '[^éñüä]', '', 'g')) > 0 THEN 'NORMAL_TEXT' ELSE 'GARBLED_TEXT' END AS state FROM documents")
def quality_first_pass(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select("doc_id", F.length("text").alias("char_count"), T.count_class(F.col("text"), "[éñüä]").alias("cjk_count"), (1 - F.col("doc_id") % 2).alias("image_count"))
    return quality.first_pass(pages).select("doc_id", "state")


@query(f"WITH {PS}, {V1} SELECT tb.doc, count(*) AS n_blocks FROM tb JOIN documents d ON d.doc_id = tb.doc JOIN labels l ON l.doc_id = tb.doc WHERE l.quality = 1 GROUP BY tb.doc")
def filter_normal_pages(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("doc")).distinct()
    return text_blocks(spark, d).join(good, "doc", "left_semi").groupBy("doc").agg(F.count("*").alias("n_blocks"))


@query("SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_page_quality(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))


# text and layout --------------------------------------------------------------


@query(f"WITH {V1} SELECT doc, page, CASE WHEN y0 < 96 THEN 'RUNNING_HEADER' ELSE 'RUNNING_FOOTER' END AS role, count(*) AS n FROM tb WHERE (y0 < 96 OR y0 > 704) AND length({STRIP}) > 0 GROUP BY ALL")
def band_candidates(spark, d):
    return layout.band_candidates(text_blocks(spark, d)).groupBy("doc", "page", "role").agg(F.count("*").alias("n"))


@query(f"WITH {FAM} SELECT * FROM fam")
def layout_families(spark, d):
    return layout.families(layout.band_candidates(text_blocks(spark, d)))


@query(f"WITH {FAM}, nb AS (SELECT doc, page, ord, {NORM} AS pattern FROM tb) SELECT nb.doc, nb.page, nb.ord::BIGINT AS ord, coalesce(min(fam.role), 'BODY') AS role FROM nb LEFT JOIN fam ON fam.doc = nb.doc AND fam.pattern = nb.pattern AND nb.page BETWEEN fam.first_page AND fam.last_page GROUP BY nb.doc, nb.page, nb.ord")
def mark_running_blocks(spark, d):
    blocks = text_blocks(spark, d)
    out = layout.mark(blocks, layout.families(layout.band_candidates(blocks)))
    return out.groupBy("doc", "page", F.col("ord").cast("long").alias("ord")).agg(F.min("role").alias("role"))


@query(f"WITH {V1} SELECT doc, ord, {NORM} AS pattern FROM tb")
def normalize_pattern(spark, d):
    return text_blocks(spark, d).select("doc", "ord", T.normalize_pattern(F.col("text")).alias("pattern"))


@query(rf"WITH {V1} SELECT doc, ord, regexp_replace(text, '[\s\p{{Z}}]+', '', 'g') AS heading FROM tb")
def normalize_heading(spark, d):
    return text_blocks(spark, d).select("doc", "ord", T.normalize_heading(F.col("text")).alias("heading"))


@query(f"WITH {V1} SELECT doc, page, string_agg(text, '' ORDER BY ord) AS page_text FROM tb GROUP BY doc, page")
def page_text(spark, d):
    rows = text_blocks(spark, d).groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return rows.select("doc", "page", F.array_join(F.col("b.text"), "").alias("page_text"))


@query(f"WITH {V1} SELECT doc, page, sum(length(replace(text, ' ', '')))::BIGINT AS char_count FROM tb GROUP BY doc, page")
def page_char_count(spark, d):
    return text_blocks(spark, d).groupBy("doc", "page").agg(F.sum(F.length(F.translate("text", " \n", ""))).alias("char_count"))


@query(f"WITH {V1} SELECT doc, ord FROM tb WHERE page = 0 AND ord < 4")
def first_blocks(spark, d):
    return text_blocks(spark, d).where("page = 0 and ord < 4").select("doc", "ord")


@query(f"WITH {V1} SELECT doc, min(page) AS anchor FROM tb WHERE font_size >= 13 AND length(text) > 0 GROUP BY doc")
def anchor_pages(spark, d):
    return text_blocks(spark, d).where("font_size >= 13 and length(text) > 0").groupBy("doc").agg(F.min("page").alias("anchor"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("SELECT doc_id, left(sha256(source || text), 16) AS input_hash FROM documents")
def llm_input_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat("source", "text"), 256), 1, 16).alias("input_hash"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS field, coalesce(json_extract_string(props, '$.missing'), 'none') AS absent, coalesce(json_extract_string(CASE WHEN event_id % 3 = 0 THEN '{\"other\": 1}' ELSE props END, '$.k'), 'none') AS some FROM events")
def llm_json_fields(spark, d):
    """A field's value, or a default where the field or the whole object is absent."""
    get = lambda x, k: F.coalesce(F.get_json_object(x, f"$.{k}"), F.lit("none"))
    some = F.when(F.col("event_id") % 3 == 0, '{"other": 1}').otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", get(F.col("props"), "k").alias("field"), get(F.col("props"), "missing").alias("absent"), get(some, "k").alias("some"))


@query(f"WITH {PS} SELECT doc, page, coalesce(last_value(CASE WHEN c IN ('N','G') THEN c END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING), 'CONTRACT_BODY') AS label FROM ps")
def label_forward_fill(spark, d):
    rows = page_states(spark, d).select("doc", "page", F.when(F.col("c").isin("N", "G"), F.col("c")).alias("label"))
    return segments.forward_fill(rows)


@query(f"WITH {PS} SELECT doc, min(page) FILTER (c = 'G') AS first_bid, max(page) FILTER (c = 'G') AS last_bid, min(page) FILTER (c = 'I') AS first_eval FROM ps GROUP BY doc")
def zone_bounds(spark, d):
    def at(c):
        return F.when(F.col("c") == c, F.col("page"))

    return page_states(spark, d).groupBy("doc").agg(F.min(at("G")).alias("first_bid"), F.max(at("G")).alias("last_bid"), F.min(at("I")).alias("first_eval"))


@query(f"WITH {PS}, t AS (SELECT *, max(page) OVER (PARTITION BY doc) AS last_page FROM ps), n AS (SELECT *, lead(page) OVER (PARTITION BY doc ORDER BY page) AS nx FROM t WHERE c = 'N') SELECT doc, page, CASE WHEN nx IS NULL THEN last_page WHEN nx = page THEN page ELSE nx - 1 END AS end_page FROM n")
def section_intervals(spark, d):
    rows = page_states(spark, d).withColumn("last_page", F.max("page").over(Window.partitionBy("doc"))).where("c = 'N'").withColumn("ord", F.lit(0))
    return segments.interval_ends(rows).select("doc", "page", "end_page")


@query("WITH f AS (SELECT user_id AS doc, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS page, event_id AS t, event_type AS s FROM events), g AS (SELECT *, CASE WHEN lag(s) OVER w = s AND s <> '' AND page - lag(page) OVER w IN (0, 1) AND page % 7 <> 0 THEN 0 ELSE 1 END AS b FROM f WINDOW w AS (PARTITION BY doc ORDER BY page, t)), h AS (SELECT *, sum(b) OVER (PARTITION BY doc ORDER BY page, t) AS grp FROM g) SELECT doc, grp::BIGINT AS grp, min(page) AS page_start, max(page) AS page_end, count(*) AS n_fragments, max(page) > min(page) AS cross_page, CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM h GROUP BY doc, grp")
def merge_fragments(spark, d):
    page = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc"), page.alias("page"), F.col("event_id").alias("t"), F.col("event_type").alias("signature"), (page % 7 == 0).alias("captioned"))
    return segments.merge_fragments(rows)


# tree ---------------------------------------------------------------------------


@query("SELECT o_custkey AS section, o_orderkey AS item FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 20")
def topn_items_per_section(spark, d):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").withColumn("r", r).where("r <= 20").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("item"))


@query("SELECT o_custkey AS section, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2")
def sections_with_pairs(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("section")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT o_orderkey AS item FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%'")
def search_items(spark, d):
    return table(spark, d, "orders").where(F.lower("o_orderpriority").contains("urgent")).select(F.col("o_orderkey").alias("item"))
