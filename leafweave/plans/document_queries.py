"""Queries of labels, contents lines, captions, classes and assembled sections.

The driver's tables hold no Chinese text, so each query reads lines that one
expression makes of every row of ``documents``; it is the same text for Spark
and DuckDB.  What is done with the lines is written twice, independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators import assemble, labels, packages, sections, segments, tables
from leafweave.plans.register import PS, V1, page_states, query, table, text_blocks

WSD = r"[\s\p{Z}]"


def case(by: str, *texts: str) -> str:
    """SQL for one of the texts, which are SQL themselves, by a number modulo how many there are."""
    whens = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    return f"CASE ({by}) % {len(texts)} {whens} END"


N = "cast(doc_id % 300 as string)"
TOC = case("doc_id", f"concat('壹、 專案目標 ....... ', {N})", f"concat('十一、其他 … ', {N}, '  ')", f"concat('（一）範圍 ··· ', {N})", f"concat('（12） 範圍　說明·', {N})", f"concat('前言 壹、專案 ... ', {N})", "'目次'", f"concat('  貳．現況…………', {N})", "'no number ....'", f"concat('(三)維運..', {N}, 'x')", f"concat('拾、', source, ' .... ', {N})", f"concat('參 、標題....', {N})")
CAPTION = case("doc_id", f"concat('表 0', {N}, '  需求說明')", f"concat('表', {N}, '交付項目')", f"concat('詳見表 ', {N}, ' 需求')", "'表格'", f"concat('　表　', {N}, '　項目 一')", f"concat('表', {N})", "source", "''")
TITLE = f"concat({case('doc_id', "'契約價金'", "'驗 收'", "'教育 訓練'", "'專案'", "'維運'", "'其他'", "'資安'", "'系統'", "'組織 '")}, {case('doc_id + doc_id / 9', "''", "'文件驗收'", "'管理'", "'期　限'", "'要求'", "'之給付'", "'背景'")})".replace("doc_id / 9", "doc_id % 5")
TYPE = case("doc_id", "'REQUIREMENT_SPECIFICATION'", "'CONTRACT_BODY'", "'ATTACHMENT'", "'BID_INSTRUCTIONS'", "'EVALUATION_GUIDELINES'")
HEADING = case("doc_id % 7 + doc_id % 4", f"concat('壹、專案目標', {N})", f"concat('貳,現況 ........ ', {N})", f"concat('第十條 驗收·· ', {N})", "'第二條'", f"concat('附件', {N}, ': 保密 切結書')", "'附件：無號'", "'十三、 投標文件'", "'第五十條付款 方式'", "'　拾．結 語'", "source")
SIZE = "cast(11 + doc_id % 5 as double)"
MIXED = f"concat(substring(text, 1, 12), {case('doc_id', "'契約 驗收，第１條'", "'契约①'", "''", "'，。！％'", "'ab驗收'", "'㈠½'")})"


def lines(spark, d, **columns: str) -> DataFrame:
    """doc_id and source of documents with columns made by expressions."""
    return table(spark, d, "documents").select("doc_id", "source", *[F.expr(x).alias(k) for k, x in columns.items()])


# lines ------------------------------------------------------------------------

_MAIN = rf"^([壹貳參肆伍陸柒捌玖拾一二三四五六七八九十]+)[、.．]{WSD}*(.+?){WSD}*[.…·]+{WSD}*(\p{{Nd}}+){WSD}*$"
_SUB = rf"^[（(]([一二三四五六七八九十\p{{Nd}}]+)[）)]{WSD}*(.+?){WSD}*[.…·]+{WSD}*(\p{{Nd}}+){WSD}*$"
_PAGED = "pg AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents d)"


def paged(spark, d, **columns: str) -> DataFrame:
    pages = page_states(spark, d)  # doc, page, c: one page a document
    order = table(spark, d, "documents").select("doc_id", F.col("source").alias("doc"), F.row_number().over(_by_source()).cast("long").alias("k"))
    return lines(spark, d, **columns).join(order.select("doc_id", "doc", (F.col("k") - 1).alias("page")), "doc_id").join(pages, ["doc", "page"])


def _by_source():
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy("doc_id")


@query(f"""WITH {PS}, {_PAGED}, r AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY doc ORDER BY page) = c THEN 0 ELSE 1 END AS new FROM ps),
 s AS (SELECT doc, page, sum(new) OVER (PARTITION BY doc ORDER BY page) AS seq FROM r), f AS (SELECT doc, seq, min(page) AS a FROM s GROUP BY ALL),
 l AS (SELECT s.doc, s.seq::BIGINT AS seq, s.page, trim({TOC}, ' 　') AS line FROM s JOIN f USING (doc, seq) JOIN pg ON pg.source = s.doc AND pg.page = s.page WHERE s.page < f.a + 8 AND doc_id % 5 < 3)
 SELECT doc, seq, page, CASE WHEN regexp_matches(line, '{_MAIN}') THEN regexp_extract(line, '{_MAIN}', 1) || '、' || regexp_extract(line, '{_MAIN}', 2) ELSE regexp_extract(line, '{_SUB}', 2) END AS title,
 regexp_extract(line, '(\\p{{Nd}}+){WSD}*$', 1)::BIGINT AS printed_page, CASE WHEN regexp_matches(line, '^.[、.．]') THEN 1 ELSE 2 END::BIGINT AS level FROM l WHERE regexp_matches(line, '{_MAIN}') OR regexp_matches(line, '{_SUB}')""")
def toc_entries(spark, d):
    """Contents lines of the first eight pages of each run that have a contents heading."""
    rows = paged(spark, d, line=TOC, head=case("doc_id", "'目 錄'", "'目次表'", "'　目次'", "'前言 目次'", "'x'"))
    blocks = rows.select("doc", "page", F.posexplode(F.array("head", "line")).alias("ord", "text"))
    return sections.contents(segments.run_length(page_states(spark, d), "c"), blocks)


_CAP = f"WITH {_PAGED}, c AS (SELECT source AS doc, page, {CAPTION} AS raw FROM pg), t AS (SELECT *, trim(raw, ' 　') AS line, regexp_replace(raw, '{WSD}', '', 'g') AS flat FROM c), k AS (SELECT doc, page, CASE WHEN regexp_matches(line, '^表{WSD}*\\p{{Nd}}+{WSD}+.+') THEN '表' || regexp_extract(line, '^表{WSD}*(\\p{{Nd}}+)', 1)::BIGINT || ' ' || regexp_extract(line, '^表{WSD}*\\p{{Nd}}+{WSD}+(.+)', 1) WHEN regexp_matches(flat, '^表\\p{{Nd}}+.+') THEN '表' || regexp_extract(flat, '^表(\\p{{Nd}}+).+', 1)::BIGINT || ' ' || regexp_extract(flat, '^表\\p{{Nd}}+(.+)', 1) ELSE '' END AS caption FROM t)"


@query(f"{_CAP} SELECT a.doc, a.page, CASE WHEN a.caption <> '' THEN a.caption ELSE coalesce(b.caption, '') END AS caption FROM k a LEFT JOIN k b ON b.doc = a.doc AND b.page = a.page - 1 WHERE a.page % 3 = 0")
def table_captions(spark, d):
    """The caption of a table's first page, else of the page before."""
    rows = paged(spark, d, line=CAPTION).select("doc", "page", F.lit(0).alias("ord"), T.caption(F.col("line")).alias("caption"))
    return tables.near_captions(page_states(spark, d).where("page % 3 = 0").select("doc", "page"), rows)


@query(f"SELECT doc_id, contains(x, '│') OR contains(x, '├') OR contains(x, '┤') OR contains(x, '─') AS law FROM (SELECT doc_id, {case('doc_id', "'│ 第一條 │'", "'├──┤'", "'第一條'", 'text', "'—|-'")} AS x FROM documents)")
def law_pages(spark, d):
    return lines(spark, d, x=case("doc_id", "'│ 第一條 │'", "'├──┤'", "'第一條'", "text", "'—|-'")).select("doc_id", T.boxed(F.col("x")).alias("law"))


_PATTERN = case("doc_id", "'投標須知 {n}'", "'{n}/{n}/{n} 評選'", "' {n} '", "'契約'", "concat(source, ' 須知')", "'{n}/{n}'")


@query(f"SELECT doc_id, doc_id % 6 IN (0, 4) AS bid, doc_id % 6 = 1 AS evaluation, doc_id % 6 = 2 AS ignored FROM documents")
def zone_families(spark, d):
    p = F.col("pattern")
    return lines(spark, d, pattern=_PATTERN).select("doc_id", labels.bid_pattern(p).alias("bid"), labels.date_pattern(p).alias("evaluation"), labels.ignored_pattern(p).alias("ignored"))


_FLAT = f"(SELECT doc_id, regexp_replace({MIXED}, '{WSD}', '', 'g') AS x FROM documents)"


@query(f"SELECT doc_id, CASE WHEN length(x) = 0 THEN 0 ELSE round(length(regexp_replace(x, '[^\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g')) / length(x), 6) END::DOUBLE AS ratio FROM {_FLAT}")
def cjk_ratio(spark, d):
    return lines(spark, d, x=MIXED).select("doc_id", F.round(T.text_stats(F.col("x"))["cjk_ratio"], 6).alias("ratio"))


# Of the characters of MIXED that DuckDB sees as ideographs or full-width, only these aren't common.
_COMMON = "regexp_replace(x, '[^\\x{3000}-\\x{303F}\\x{FF01}-\\x{FF60}\\x{4E00}-\\x{9FFF}]|约', '', 'g')"


@query(f"SELECT doc_id, length({_COMMON}) AS n_common, CASE WHEN length(x) = 0 THEN 0 ELSE round(length({_COMMON}) / length(x), 6) END::DOUBLE AS ratio FROM {_FLAT}")
def common_han_ratio(spark, d):
    s = T.text_stats(F.col("x"))
    return lines(spark, d, x=MIXED).select("doc_id", s["common_han_count"].alias("n_common"), F.round(s["common_han_ratio"], 6).alias("ratio"))


_REST = f"(SELECT doc_id, length(x) AS char_count, length({_COMMON}) AS common_han_count, regexp_replace(x, '[\\x{{3000}}-\\x{{303F}}\\x{{FF01}}-\\x{{FF60}}契約驗收第條]', '', 'g') AS rest FROM (SELECT doc_id, regexp_replace(text || {case('doc_id', "'契約 驗收，第１條'", "'契约①'", "''", "'，。！％'", "'ab驗收'", "'㈠½'")}, '{WSD}', '', 'g') AS x FROM documents))"
_SHARES = ", ".join(f"CASE WHEN char_count = 0 THEN 0 ELSE round({k}_count / char_count, 6) END::DOUBLE AS {k}_ratio" for k in ("common_han", "alnum", "symbol"))


@query(f"SELECT *, {_SHARES} FROM (SELECT doc_id, char_count, common_han_count, length(regexp_replace(rest, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum_count, length(regexp_replace(rest, '[^\\p{{P}}\\p{{S}}\\p{{Cc}}]', '', 'g')) AS symbol_count FROM {_REST})")
def page_text_stats(spark, d):
    s = T.text_stats(F.concat("text", F.expr(case("doc_id", "'契約 驗收，第１條'", "'契约①'", "''", "'，。！％'", "'ab驗收'", "'㈠½'"))))
    rows = table(spark, d, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", "s.char_count", *[f"s.{k}_count" for k in ("common_han", "alnum", "symbol")], *[F.round(f"s.{k}_ratio", 6).alias(f"{k}_ratio") for k in ("common_han", "alnum", "symbol")])


_CLASSES = "CASE WHEN regexp_matches(t, '價金|給付|付款|計價|費用') THEN 'PAYMENT' WHEN regexp_matches(t, '驗收|查驗') THEN 'ACCEPTANCE' WHEN regexp_matches(t, '訓練|教育') THEN 'TRAINING' WHEN regexp_matches(t, '退場|移轉') THEN 'TRANSITION' WHEN regexp_matches(t, '目標|範圍|概述|背景') THEN 'SCOPE' WHEN regexp_matches(t, '維運|維護|保養|支援') THEN 'MAINTENANCE' WHEN regexp_matches(t, '交付|產出|文件|報告') THEN 'DELIVERABLE' WHEN regexp_matches(t, '時程|期限|里程碑') THEN 'MILESTONE' WHEN regexp_matches(t, '品質|檢核') THEN 'QUALITY' WHEN regexp_matches(t, '管理|組織|人力') THEN 'MANAGEMENT' WHEN regexp_matches(t, '限制|約束|條件') THEN 'CONSTRAINT' WHEN regexp_matches(t, '安全|資安') THEN 'SECURITY_ACTIVITY' WHEN regexp_matches(t, '功能|系統|新增|異動') THEN 'SCOPE' ELSE 'UNCLASSIFIED' END"
_TITLED = f"(SELECT doc_id, regexp_replace({TITLE}, '{WSD}', '', 'g') AS t FROM documents)"


@query(f"SELECT doc_id, {_CLASSES} AS category FROM {_TITLED}")
def rule_classify(spark, d):
    return lines(spark, d, title=TITLE).select("doc_id", T.classify_title(F.col("title")).alias("category"))


@query(f"SELECT doc_id, CASE WHEN rule <> 'UNCLASSIFIED' OR doc_id % 7 = 0 OR quality = 0 OR toxic = 1 THEN rule ELSE 'SCOPE' END AS category FROM (SELECT doc_id, {_CLASSES} AS rule FROM {_TITLED}) LEFT JOIN labels USING (doc_id)")
def classify_mock(spark, d):
    """The stand-in model is asked about clean sections with text that aren't excluded; its answer counts where no rule matched."""
    known = table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"), F.when(F.col("toxic") == 1, "EXCLUDED").otherwise("PRIMARY").alias("priority"))
    rows = lines(spark, d, title=TITLE, content="CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END").join(known, "doc_id", "left")
    rule = T.classify_title(F.col("title"))
    asked = sections.asked(F.col("content"), F.coalesce("bad", F.lit(False)), F.coalesce("priority", F.lit("PRIMARY")))
    return rows.select("doc_id", sections.final_category(rule, F.when(asked, "SCOPE")).alias("category"))


_HEADED = f"(SELECT doc_id, {TYPE} AS kind, {HEADING} AS raw, regexp_replace({HEADING}, '{WSD}', '', 'g') AS h, {SIZE} AS size FROM documents)"


@query(rf"""SELECT * FROM (SELECT doc_id, CASE
 WHEN kind = 'REQUIREMENT_SPECIFICATION' AND size >= 13 AND NOT contains(raw, '....') AND NOT contains(raw, '…') AND regexp_matches(h, '^[壹貳參肆伍陸柒捌玖拾][、.．,].') THEN h[1:1] || '、' || h[3:]
 WHEN kind = 'CONTRACT_BODY' AND size >= 13 AND NOT contains(raw, '....') AND NOT contains(raw, '…') AND regexp_matches(h, '^第[一二三四五六七八九十百]+條.') THEN regexp_extract(h, '^第[^條]+條') || ' ' || regexp_replace(regexp_extract(h, '條(.+)$', 1), '[.…·]+\p{{Nd}}*$', '')
 WHEN kind = 'ATTACHMENT' AND size >= 14 AND regexp_matches(h, '^附件\p{{Nd}}+[：:].') THEN regexp_extract(h, '^附件\p{{Nd}}+') || '：' || regexp_extract(h, '[：:](.+)$', 1)
 WHEN kind = 'BID_INSTRUCTIONS' AND size >= 12 AND regexp_matches(h, '^(第[一二三四五六七八九十百]+條|[一二三四五六七八九十]+[、.]).') THEN regexp_extract(h, '^(第[一二三四五六七八九十百]+條|[一二三四五六七八九十]+[、.])') || ' ' || regexp_extract(h, '^(?:第[一二三四五六七八九十百]+條|[一二三四五六七八九十]+[、.])(.+)$', 1) END AS title FROM {_HEADED}) WHERE title IS NOT NULL""")
def section_titles(spark, d):
    rows = lines(spark, d, kind=TYPE, text=HEADING, size=SIZE)
    return rows.select("doc_id", sections.title(F.col("kind"), F.col("text"), F.col("size")).alias("title")).where("title is not null")


# labels -----------------------------------------------------------------------

_BLOCK = case("doc_id % 60", *[{5: "'附件3 服務'", 9: "'附件七'", 16: "' 立 契約人'", 23: "'公開 招標公告'", 31: "'│表格│'", 40: "'附件2 ..... 7'"}.get(i, "source") for i in range(60)])
_STATE = "CASE c WHEN 'N' THEN 'NORMAL_TEXT' WHEN 'E' THEN 'NORMAL_TEXT' WHEN 'G' THEN 'GARBLED_TEXT' ELSE 'IMAGE_ONLY' END"
#: (family, role, pattern, its pages): list order is by family
_FAMILIES = ((0, "RUNNING_HEADER", "{n}/{n}/{n} 甲", "doc_id % 37 = 6"), (1, "RUNNING_HEADER", "{n}/{n}/{n} 乙", "doc_id % 41 = 3"), (2, "RUNNING_FOOTER", "投標 {n}", "doc_id % 43 = 2"), (3, "RUNNING_FOOTER", "投標須知 {n}", "doc_id % 29 = 2"), (4, "RUNNING_FOOTER", "頁 {n}", "doc_id % 58 = 2"), (5, "RUNNING_FOOTER", "{n}", "doc_id % 2 = 0"))
_FAMILY_SQL = " UNION ALL ".join(f"SELECT source AS doc, page, {k} AS family, '{r}' AS role, '{p}' AS pattern FROM pg WHERE {w}" for k, r, p, w in _FAMILIES if p != "{n}")
_NOT_FREE = "min(CASE WHEN l IS NOT NULL THEN page END)"


def _step(name: str, of: str, bounds: str, cond: str, label: str) -> str:
    """A CTE that lays a label over the free pages of the one before."""
    return f"{name} AS (SELECT q.* EXCLUDE (l), CASE WHEN l IS NULL AND ({cond}) THEN '{label}' ELSE l END AS l FROM {of} q LEFT JOIN {bounds} b USING (doc))"


LABELS_SQL = f"""WITH {PS}, {_PAGED}, fam AS ({_FAMILY_SQL}), scan AS (SELECT *, family + CASE role WHEN 'RUNNING_HEADER' THEN 100 ELSE 0 END AS k FROM fam),
 bid AS (SELECT doc, max(k) AS k FROM scan WHERE contains(pattern, '投標') GROUP BY doc), ev AS (SELECT doc, max(k) AS k FROM scan WHERE contains(pattern, '{{n}}/{{n}}/{{n}}') GROUP BY doc),
 foot AS (SELECT doc, page, max(k) AS k FROM scan WHERE role = 'RUNNING_FOOTER' GROUP BY ALL), head AS (SELECT doc, page, max(k) AS k FROM scan WHERE role = 'RUNNING_HEADER' GROUP BY ALL),
 bp AS (SELECT doc, page FROM foot SEMI JOIN bid USING (doc, k)), ep AS (SELECT doc, page FROM head SEMI JOIN ev USING (doc, k)),
 p0 AS (SELECT ps.doc, ps.page, {_STATE} AS q, regexp_replace({_BLOCK}, '{WSD}', '', 'g') AS t, {_BLOCK} AS raw, doc_id % 2 = 0 AS big, CASE WHEN (ps.doc, ps.page) IN (SELECT (doc, page) FROM ep) THEN 'EVALUATION_GUIDELINES' WHEN (ps.doc, ps.page) IN (SELECT (doc, page) FROM bp) THEN 'BID_INSTRUCTIONS' WHEN c = 'I' THEN 'SCANNED_PAGES' WHEN c = 'G' THEN 'SERVICE_PROPOSAL' END AS l FROM ps JOIN pg ON pg.source = ps.doc AND pg.page = ps.page),
 p1 AS (SELECT * EXCLUDE (l), CASE WHEN l IS NULL AND q = 'NORMAL_TEXT' AND contains(t, '│') THEN 'LAW_OR_POLICY' ELSE l END AS l FROM p0),
 a AS (SELECT doc, min(page) FILTER (regexp_matches(t, '^附件[0-9一二三四五六七八九十]') AND big AND NOT contains(raw, '....')) AS att, min(page) FILTER (t LIKE '立契約人%') AS sig, min(page) FILTER (contains(t, '招標公告')) AS ten FROM p1 WHERE l IS NULL AND q = 'NORMAL_TEXT' GROUP BY doc),
 z AS (SELECT doc, (SELECT min(page) FROM bp WHERE bp.doc = d.doc) AS b0, (SELECT max(page) FROM bp WHERE bp.doc = d.doc) AS b1, (SELECT min(page) FROM ep WHERE ep.doc = d.doc) AS e0, (SELECT max(page) FROM ep WHERE ep.doc = d.doc) AS e1 FROM (SELECT DISTINCT doc FROM ps) d),
 s1 AS (SELECT doc, ten, (SELECT {_NOT_FREE} FROM p1 WHERE p1.doc = a.doc AND p1.page > a.ten) AS stop FROM a), {_step("p2", "p1", "s1", "page >= ten AND page < coalesce(stop, page + 1)", "TENDER_ANNOUNCEMENT")},
 {_step("p3", "p2", "z", "page > b1 AND page < e0", "EVALUATION_GUIDELINES")}, s2 AS (SELECT doc, e1, (SELECT {_NOT_FREE} FROM p3 WHERE p3.doc = z.doc AND p3.page > z.e1) AS stop FROM z),
 {_step("p4", "p3", "s2", "page > e1 AND page < coalesce(stop, page + 1)", "EVALUATION_GUIDELINES")}, az AS (SELECT * FROM z LEFT JOIN a USING (doc)), {_step("p5", "p4", "az", "page > sig AND page < b0", "REQUIREMENT_SPECIFICATION")},
 {_step("p6", "p5", "az", "page >= att AND page < coalesce(sig, b0, page + 1)", "ATTACHMENT")}, p7 AS (SELECT doc, page, CASE WHEN page = sig THEN 'SIGNATURE_PAGE' ELSE l END AS l FROM p6 LEFT JOIN a USING (doc)),
 lab AS (SELECT doc, page, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING), 'CONTRACT_BODY') AS label FROM p7)"""


def _labelled(spark, d) -> DataFrame:
    rows = paged(spark, d, text=_BLOCK, font_size="CASE WHEN doc_id % 2 = 0 THEN 14.0D ELSE 13.0D END".replace("14.0D", "cast(14 as double)").replace("13.0D", "cast(13 as double)"))
    pages = rows.select("doc", "page", F.expr(_STATE).alias("quality"))
    found = [rows.where(w).select("doc", "page", F.lit(k).alias("family"), F.lit(r).alias("role"), F.lit(p).alias("pattern")) for k, r, p, w in _FAMILIES]
    families = found[0]
    for f in found[1:]:
        families = families.unionByName(f)
    return labels.page_labels(pages, rows.select("doc", "page", F.lit(0).alias("ord"), "text", "font_size"), families)


@query(f"{LABELS_SQL} SELECT doc, page, label FROM lab")
def subdoc_labels(spark, d):
    return _labelled(spark, d).select("doc", "page", "label")


_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (("CONTRACT_BODY", "契約本文"), ("ATTACHMENT", "附件"), ("SIGNATURE_PAGE", "簽署頁"), ("REQUIREMENT_SPECIFICATION", "需求規範書"), ("BID_INSTRUCTIONS", "投標須知"), ("EVALUATION_GUIDELINES", "評選須知"), ("TENDER_ANNOUNCEMENT", "招標公告"), ("SCANNED_PAGES", "掃描頁"), ("LAW_OR_POLICY", "法規文件"), ("SERVICE_PROPOSAL", "服務建議書")))


@query(f"{LABELS_SQL}, n AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc ORDER BY page) = label THEN 0 ELSE 1 END AS new FROM lab), q AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY page) AS seq FROM n) SELECT doc, printf('subdoc-%03d', seq::INTEGER) AS subdoc, label AS doc_type, CASE label {_MAP} END AS title, min(page) AS page_start, max(page) AS page_end, count(*) AS page_count FROM q GROUP BY doc, seq, label")
def subdoc_segments(spark, d):
    runs = labels.titled(segments.run_length(_labelled(spark, d)))
    return runs.select("doc", F.format_string("subdoc-%03d", "seq").alias("subdoc"), "doc_type", "title", F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"), F.col("n_pages").alias("page_count"))


@query(f"WITH {PS}, a AS (SELECT doc, min(page) AS a, max(page) FILTER (page < 12) AS last_bid FROM ps WHERE c = 'G' GROUP BY doc), e AS (SELECT doc, min(page) AS first_eval FROM ps WHERE c = 'I' AND page > 20 GROUP BY doc), f AS (SELECT ps.*, CASE WHEN c = 'G' AND page < 12 THEN 'BID' WHEN c = 'I' AND page > 20 THEN 'EVAL' WHEN c = 'N' AND page % 4 = 0 THEN 'X' END AS l FROM ps) SELECT f.doc, f.page, coalesce(l, CASE WHEN page > last_bid AND page < first_eval THEN 'EVAL' END, '') AS label FROM f LEFT JOIN a USING (doc) LEFT JOIN e USING (doc)")
def label_gap_fill(spark, d):
    """Free pages between the last page of one zone and the first of another."""
    at = F.when((F.col("c") == "G") & (F.col("page") < 12), "BID").when((F.col("c") == "I") & (F.col("page") > 20), "EVAL").when((F.col("c") == "N") & (F.col("page") % 4 == 0), "X")
    rows = page_states(spark, d).select("doc", "page", at.alias("label"))
    return labels.gap_fill(rows, "BID", "EVAL", "EVAL").select("doc", "page", F.coalesce("label", F.lit("")).alias("label"))


# assembled sections -------------------------------------------------------------

_LINE = "CASE WHEN ord % 7 = 3 THEN concat('表 ', cast(ord as string), ' ', text) WHEN ord % 11 = 5 THEN '  ' ELSE text END"
_ROLE = "CASE WHEN ord % 13 = 0 THEN 'RUNNING_HEADER' WHEN ord % 13 = 12 THEN 'PAGE_NUMBER' ELSE 'BODY' END"
_RANGE = "(SELECT doc, max(page) AS last_page FROM tb GROUP BY doc)"


@query(f"""WITH {V1}, pgs AS (SELECT DISTINCT doc, page FROM tb WHERE page % 5 <> 4), sec AS (SELECT doc, k::BIGINT AS section, 'S' || k AS title, k * 2 AS a, k * 2 + 2 AS b FROM {_RANGE}, range(0, 6) r(k) WHERE k * 2 <= last_page),
 tab AS (SELECT doc, k AS "table", k AS a, k + k % 3 AS b, CASE WHEN k % 2 = 1 THEN '表' || k ELSE '' END AS caption, CASE WHEN k % 4 = 2 THEN '' ELSE '| h |' || chr(10) || '| --- |' || chr(10) || '| ' || k || ' |' || chr(10) END AS md FROM {_RANGE}, range(0, 11) r(k) WHERE k <= last_page),
 sp AS (SELECT sec.doc, section, title, page FROM sec JOIN pgs ON pgs.doc = sec.doc AND page BETWEEN a AND b),
 bl AS (SELECT doc, page, ord, trim({_LINE}, E' \\t\\r') AS t FROM tb WHERE {_ROLE} = 'BODY' AND ord % 17 <> 8), ok AS (SELECT *, regexp_matches(regexp_replace(t, '{WSD}', '', 'g'), '^表\\p{{Nd}}+') AS cap FROM bl WHERE t <> ''),
 fc AS (SELECT doc, page, min(ord) AS ord, arg_min(t, ord) AS t FROM ok WHERE cap GROUP BY ALL),
 cand AS (SELECT sp.doc, sp.section, tab."table", sp.page, fc.ord, fc.t, tab.caption, tab.md, row_number() OVER (PARTITION BY sp.doc, sp.section, tab."table" ORDER BY sp.page) AS r FROM sp JOIN tab ON tab.doc = sp.doc AND sp.page BETWEEN tab.a AND tab.b LEFT JOIN fc ON fc.doc = sp.doc AND fc.page = sp.page WHERE fc.ord IS NOT NULL OR sp.page = tab.a),
 parts AS (SELECT sp.doc, sp.section, sp.page, 0 AS ph, ok.ord, -1 AS tb, 0 AS sub, ok.t || chr(10) AS part FROM sp JOIN ok ON ok.doc = sp.doc AND ok.page = sp.page AND NOT cap
  UNION ALL SELECT doc, section, page, CASE WHEN ord IS NULL THEN 1 ELSE 0 END, coalesce(ord, 0), "table", 0, chr(10) || coalesce(t, caption) || chr(10) FROM cand WHERE r = 1 AND coalesce(t, caption) <> ''
  UNION ALL SELECT doc, section, page, CASE WHEN ord IS NULL THEN 1 ELSE 0 END, coalesce(ord, 0), "table", 1, md FROM cand WHERE r = 1)
 SELECT sec.doc, sec.section, '# ' || sec.title || chr(10) || coalesce(chr(10) || string_agg(part, chr(10) ORDER BY page, ph, ord, tb, sub), '') AS markdown FROM sec LEFT JOIN parts ON parts.doc = sec.doc AND parts.section = sec.section GROUP BY sec.doc, sec.section, sec.title""")
def assemble_markdown(spark, d):
    """Sections of three pages each, with tables over one to three pages; every fifth page isn't normal."""
    blocks = text_blocks(spark, d).select("doc", "page", "ord", F.expr(_LINE).alias("text"), F.expr(_ROLE).alias("role"), F.expr("ord % 17 = 8").alias("exclude"))
    last = blocks.groupBy("doc").agg(F.max("page").alias("last"))
    k = last.select("doc", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.least("last", F.lit(10)))).alias("k"))
    found = k.where("k <= 5 and 2 * k <= last").select("doc", F.col("k").alias("section"), F.concat(F.lit("S"), "k").alias("title"), (F.col("k") * 2).alias("start_page"), (F.col("k") * 2 + 2).alias("end_page"))
    own = F.when(F.col("k") % 4 == 2, "").otherwise(F.concat(F.lit("| h |\n| --- |\n| "), F.col("k").cast("string"), F.lit(" |\n")))
    has = k.select("doc", F.col("k").alias("table"), F.col("k").alias("page_start"), (F.col("k") + F.col("k") % 3).alias("page_end"), F.when(F.col("k") % 2 == 1, F.concat(F.lit("表"), "k")).otherwise("").alias("caption"), own.alias("markdown"))
    pages = blocks.select("doc", "page").distinct().withColumn("quality", F.when(F.col("page") % 5 == 4, "GARBLED_TEXT").otherwise("NORMAL_TEXT"))
    return assemble.sections(found, pages, blocks, has)


# trees from a model's nodes -------------------------------------------------------

_NODE = "concat('T', cast(c_custkey % 53 as string), CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE '' END)"
_KIDS = ("concat('T', cast((c_custkey * 7) % 61 as string))", "'  '", "concat(' U', cast(c_custkey % 5 as string))")


@query(f"""WITH n AS (SELECT c_nationkey::BIGINT AS subdoc, c_custkey AS pos, trim({_NODE}) AS title, CASE c_custkey % 3 WHEN 0 THEN [trim({_KIDS[0]}), trim({_KIDS[2]})] WHEN 1 THEN [trim({_KIDS[0]})] ELSE [] END AS kids FROM customer WHERE c_custkey % 5 < 2),
 l AS (SELECT DISTINCT subdoc, unnest(kids) AS title FROM n), kept AS (SELECT * FROM n ANTI JOIN l USING (subdoc, title)), off AS (SELECT * FROM n SEMI JOIN l USING (subdoc, title)),
 k3 AS (SELECT subdoc, pos, unnest(kids) AS title, generate_subscripts(kids, 1) AS child FROM kept), tg AS (SELECT subdoc, title, max((pos, child)) AS at FROM k3 GROUP BY ALL),
 got AS (SELECT off.subdoc, tg.at, string_agg(off.pos::VARCHAR, ',' ORDER BY off.pos) AS items FROM off JOIN tg USING (subdoc, title) GROUP BY ALL),
 al AS (SELECT subdoc, 0 AS stage, -1 AS pos, -1 AS child, 'root ' || subdoc AS title, 1 AS level, '' AS items FROM (SELECT DISTINCT subdoc FROM n) UNION ALL SELECT subdoc, 1, pos, -1, title, 2, pos::VARCHAR FROM kept
  UNION ALL SELECT k3.subdoc, 1, k3.pos, k3.child, k3.title, 3, coalesce(got.items, '') FROM k3 LEFT JOIN got ON got.subdoc = k3.subdoc AND got.at = (k3.pos, k3.child) UNION ALL SELECT subdoc, 2, pos, -1, title, 2, pos::VARCHAR FROM off ANTI JOIN tg USING (subdoc, title)),
 num AS (SELECT *, row_number() OVER (ORDER BY subdoc, stage, pos, child) AS id FROM al)
 SELECT subdoc, 'wbs-' || id AS node, title, level::BIGINT AS level, CASE level WHEN 1 THEN '' ELSE 'wbs-' || (SELECT max(u.id) FROM num u WHERE u.level = num.level - 1 AND u.id < num.id) END AS parent, items FROM num""")
def localwbs_from_nodes(spark, d):
    """Two fifths of the customers as a model's nodes, a nation as a subdocument."""
    kids = F.expr(f"CASE c_custkey % 3 WHEN 0 THEN array({', '.join(_KIDS)}) WHEN 1 THEN array({_KIDS[0]}) END")
    nodes = table(spark, d, "customer").where("c_custkey % 5 < 2").select(F.lit("tree").alias("doc"), F.col("c_nationkey").cast("long").alias("subdoc"), F.col("c_custkey").alias("pos"), F.expr(_NODE).alias("title"), kids.alias("children"), F.array(F.col("c_custkey").cast("string")).alias("work_items"))
    titles = table(spark, d, "nation").select(F.lit("tree").alias("doc"), F.col("n_nationkey").cast("long").alias("subdoc"), F.concat(F.lit("root "), "n_nationkey").alias("title"))
    out = packages.from_nodes(packages.usable(nodes), titles)
    return out.select("subdoc", "node", "title", "level", "parent", F.array_join("work_items", ",").alias("items"))


# stage records --------------------------------------------------------------------

_STATUS = case("doc_id + doc_id % 11", "'DONE'", "'DONE'", "'FAILED'", "'DONE'", "'STALE'", "'PENDING'")


def _records(spark, d) -> DataFrame:
    return lines(spark, d, project="cast(floor(doc_id / 15) as bigint)", ordinal="doc_id % 15 + 1", status=_STATUS, input_hash="cast(doc_id % 4 as string)", now="cast(doc_id % 3 as string)").drop("source")


_RUNS = f"(SELECT doc_id // 15 AS project, doc_id % 15 + 1 AS ordinal, {_STATUS} AS status, doc_id % 4 = doc_id % 3 AS same FROM documents)"


@query(f"SELECT project, min(ordinal) AS pending FROM {_RUNS} WHERE status <> 'DONE' GROUP BY 1")
def stage_first_pending(spark, d):
    from leafweave.engine import manifest

    return manifest.first_pending(_records(spark, d))


@query(f"SELECT project, ordinal, CASE WHEN ordinal > 4 AND status = 'DONE' THEN 'STALE' ELSE status END AS status FROM {_RUNS}")
def stage_downstream_stale(spark, d):
    from leafweave.engine import manifest

    return manifest.downstream_stale(_records(spark, d), 4).select("project", "ordinal", "status")


@query(f"SELECT project, ordinal, status = 'DONE' AND same AS skip FROM {_RUNS}")
def stage_should_skip(spark, d):
    from leafweave.engine import manifest

    return _records(spark, d).select("project", "ordinal", manifest.should_skip(F.col("status"), F.col("input_hash"), F.col("now")).alias("skip"))


