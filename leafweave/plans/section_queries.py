"""Queries of sections, table rendering, chunks and common characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators import chunks, sections
from leafweave.plans.register import V1, query, table, text_blocks

_TYPES = ("REQUIREMENT_SPECIFICATION", "CONTRACT_BODY", "ATTACHMENT", "LAW_OR_POLICY", "SERVICE_PROPOSAL")


@query("""WITH s AS (SELECT p_partkey, ['REQUIREMENT_SPECIFICATION','CONTRACT_BODY','ATTACHMENT','LAW_OR_POLICY','SERVICE_PROPOSAL'][p_partkey % 5 + 1] AS t, ['PAYMENT','SCOPE','TRAINING'][p_size % 3 + 1] AS c FROM part)
 SELECT p_partkey, CASE t WHEN 'LAW_OR_POLICY' THEN 'EXCLUDED' WHEN 'CONTRACT_BODY' THEN 'SECONDARY' WHEN 'ATTACHMENT' THEN CASE c WHEN 'SCOPE' THEN 'SECONDARY' ELSE 'PRIMARY' END ELSE 'PRIMARY' END AS priority,
 CASE t WHEN 'LAW_OR_POLICY' THEN 0.05 WHEN 'CONTRACT_BODY' THEN 0.6 WHEN 'ATTACHMENT' THEN CASE c WHEN 'SCOPE' THEN 0.5 ELSE 0.9 END WHEN 'REQUIREMENT_SPECIFICATION' THEN 0.95 ELSE 0.8 END::DOUBLE AS relevance FROM s""")
def section_priority(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    category = F.element_at(F.array(*map(F.lit, ("PAYMENT", "SCOPE", "TRAINING"))), F.col("p_size") % 3 + 1)
    return table(spark, d, "part").select("p_partkey", sections.priority(kind, category).alias("p")).select("p_partkey", "p.*")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTANCE' WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'PAYMENT' ELSE 'SCOPE' END ELSE 'UNCLASSIFIED' END AS category FROM orders")
def item_category(spark, d):
    answer = F.when(F.col("o_orderstatus") == "F", "ACCEPTANCE").when(F.col("o_orderstatus") == "O", "SCOPE").otherwise("no such name")
    return table(spark, d, "orders").select("o_orderkey", sections.item_category(answer, F.when(F.col("o_custkey") % 2 == 0, "PAYMENT").otherwise("SCOPE")).alias("category"))


@query(f"WITH {V1} SELECT doc, ord FROM tb WHERE ord % 10 NOT IN (0, 9) AND ord % 4 <> 3")
def content_blocks(spark, d):
    role = F.when(F.col("ord") % 10 == 0, "RUNNING_HEADER").when(F.col("ord") % 10 == 9, "PAGE_NUMBER")
    return sections.content_blocks(text_blocks(spark, d).withColumn("role", role).withColumn("exclude", F.col("ord") % 4 == 3)).select("doc", "ord")


@query("SELECT o_orderkey AS \"table\", left(o_orderpriority, 30) AS caption, 'p' || (min(l_linenumber) + 1) || '-p' || (max(l_linenumber) + 1) AS pages, count(*) AS n_rows FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY o_orderkey, o_orderpriority")
def inspect_tables(spark, d):
    caption = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))
    captions = table(spark, d, "orders").select(F.col("o_orderkey").alias("table"), caption.alias("caption")).where("caption <> ''")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table")).agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.count("*").alias("n_rows"))
    return captions.join(rows, "table").select("table", F.substring("caption", 1, 30).alias("caption"), F.format_string("p%d-p%d", F.col("a") + 1, F.col("b") + 1).alias("pages"), "n_rows")


def _tables(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("r"))
    return rows.select("table", F.array(F.lit("flag"), F.lit("status")).alias("header"), F.transform("r", lambda x: F.array(x["l_returnflag"], x["l_linestatus"], F.lit("cut"))).alias("rows"))


_LINES = "WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS k, '| ' || l_returnflag || ' | ' || l_linestatus || ' |' AS line FROM lineitem)"
_HEAD = "'| flag | status |' || chr(10) || '| --- | --- |' || chr(10)"


@query(f"{_LINES} SELECT l_orderkey AS \"table\", {_HEAD} || string_agg(line, chr(10) ORDER BY k) || chr(10) AS markdown FROM r GROUP BY 1")
def table_markdown(spark, d):
    return _tables(spark, d).select("table", chunks.markdown(F.col("header"), F.col("rows")).alias("markdown"))


@query(f"{_LINES} SELECT l_orderkey AS \"table\", k // 3 AS chunk, 'T' || chr(10) || {_HEAD} || string_agg(line, chr(10) ORDER BY k) AS text FROM r GROUP BY 1, 2")
def chunk_table_rows(spark, d):
    """Caption and header take 35 characters with their newlines and a row 10, so 70 hold three rows."""
    made = chunks.chunk_table_rows(F.lit("T"), F.col("header"), F.col("rows"), 70)
    return _tables(spark, d).select("table", F.posexplode(made).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x1c-\x1f]+|[\s\p{{Z}}\x1c-\x1f]+$', '', 'g')"


def _fold(parts: str) -> str:
    """DuckDB SQL for a list of parts packed into one string, pieces apart by chr(2)."""
    now = "split_part(a, chr(2), -1)"
    return f"list_reduce(list_prepend('', {parts}), lambda a, s: CASE WHEN length({now}) + length(s) + 1 > 2500 AND {_TRIM.format(now)} <> '' THEN a || chr(2) || s WHEN {now} = '' THEN a || s ELSE a || chr(10) || s END)"


def _split(packed: str) -> str:
    return f"list_filter(list_transform(string_split({packed}, chr(2)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')"


@query(rf"""WITH d AS (SELECT doc_id, text FROM documents), ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM d WHERE length(text) > 2500),
 b AS (SELECT *, k > 1 AND ((line = '' AND k < n) OR regexp_matches(line, '^#{{1,4}}[\s\p{{Z}}]') OR (regexp_matches(line, '^#{{1,4}}$') AND k < n) OR regexp_matches(line, '^表[\s\p{{Z}}]*\p{{Nd}}') OR line LIKE '|%') AS new FROM ln),
 g AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS seg FROM b), sg AS (SELECT doc_id, seg, string_agg(line, chr(10) ORDER BY k) AS s FROM g GROUP BY ALL),
 p AS (SELECT doc_id, list(s ORDER BY seg) FILTER ({_TRIM.format('s')} <> '') AS parts FROM sg GROUP BY 1), one AS (SELECT doc_id, {_split(_fold("coalesce(parts, [])"))} AS cs FROM p),
 two AS (SELECT doc_id, flatten(list_transform(cs, lambda c: CASE WHEN length(c) <= 2500 THEN [c] ELSE {_split(_fold("string_split(c, chr(10))"))} END)) AS cs FROM one),
 al AS (SELECT d.doc_id, CASE WHEN length(text) <= 2500 THEN [text] WHEN len(cs) > 0 THEN cs ELSE [left(text, 2500)] END AS cs FROM d LEFT JOIN two USING (doc_id))
 SELECT doc_id, generate_subscripts(cs, 1)::BIGINT - 1 AS chunk, unnest(cs) AS text FROM al""")
def chunk_text(spark, d):
    made = chunks.chunk_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(made).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


@query("WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, '- ' || o_orderkey || ': ' || left(o_orderpriority || ' ' || o_orderstatus, 100) AS line FROM orders) SELECT o_custkey AS section, string_agg(line, chr(10) ORDER BY k) AS prompt FROM i WHERE k <= 50 GROUP BY 1 HAVING count(*) > 1")
def relation_prompt(spark, d):
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("item_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description"))
    return sections.relation_prompts(items)
