"""Queries of items, work-package trees, validation and exports.

The tree is region > nation > customer, with three customers in ten below the
customer before them, so it is up to six levels deep.  Orders are items; the
bridge attaches them to customers, some also to a region, and some ids that
no order has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafweave.operators import tree, validate
from leafweave.plans.register import PS, page_states, query, table
from leafweave.plans.table_queries import SEG, runs
from leafweave.sinks import export

_ADJ = """adj AS (SELECT 'r' || r_regionkey AS node, '' AS parent, r_regionkey::BIGINT AS ord, r_name AS title, 'EXPLICIT' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, 'INFERRED' FROM nation
 UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 10 IN (1, 2, 3) AND c_custkey > 3 THEN 'c' || (c_custkey - 1) ELSE 'n' || c_nationkey END, c_custkey, c_name || ' (' || c_mktsegment || ')', 'EXPLICIT' FROM customer)"""
CODES = f"""{_ADJ}, rk AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord, node) AS k FROM adj), tr AS (SELECT node, parent, title, type, ord, 1 AS level, k::VARCHAR AS code FROM rk WHERE parent = ''
 UNION ALL SELECT rk.node, rk.parent, rk.title, rk.type, rk.ord, tr.level + 1, tr.code || '.' || rk.k FROM rk JOIN tr ON rk.parent = tr.node)"""
BRIDGE = "br AS (SELECT 'c' || o_custkey AS node, o_orderkey AS item FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'r0', o_orderkey FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'c' || c_custkey, -c_custkey FROM customer WHERE c_custkey % 50 = 0)"
_CLOSURE = "cl AS (SELECT node, node AS above, parent FROM adj UNION ALL SELECT cl.node, adj.node, adj.parent FROM cl JOIN adj ON adj.node = cl.parent)"


def adjacency(spark, d) -> DataFrame:
    """doc, node, parent, ord, title, type."""
    key = lambda c, k: F.concat(F.lit(c), F.col(k).cast("string"))
    one = table(spark, d, "region").select(key("r", "r_regionkey").alias("node"), F.lit("").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("title"), F.lit("EXPLICIT").alias("type"))
    two = table(spark, d, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("title"), F.lit("INFERRED").alias("type"))
    below = (F.col("c_custkey") % 10).isin(1, 2, 3) & (F.col("c_custkey") > 3)
    three = table(spark, d, "customer").select(key("c", "c_custkey").alias("node"), F.when(below, F.concat(F.lit("c"), (F.col("c_custkey") - 1).cast("string"))).otherwise(key("n", "c_nationkey")).alias("parent"), F.col("c_custkey").alias("ord"), F.format_string("%s (%s)", "c_name", "c_mktsegment").alias("title"), F.lit("EXPLICIT").alias("type"))
    return one.unionByName(two).unionByName(three).select(F.lit("t").alias("doc"), "*")


def nodes(spark, d) -> DataFrame:
    """node, parent, ord, title, type, code, level of the whole tree."""
    adj = adjacency(spark, d)
    found = tree.paths(adj).select("node", "code", F.col("depth").alias("level"))
    return adj.drop("doc").join(found, "node")


def bridge(spark, d) -> DataFrame:
    """node, item: what is attached where."""
    orders = table(spark, d, "orders")
    own = orders.where("o_orderstatus <> 'P'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.col("o_orderkey").alias("item"))
    twice = orders.where("o_orderkey % 97 = 0").select(F.lit("r0").alias("node"), F.col("o_orderkey").alias("item"))
    dangling = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), (-F.col("c_custkey")).alias("item"))
    return own.unionByName(twice).unionByName(dangling)


def items(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("section"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"))


# items ------------------------------------------------------------------------


@query("SELECT o_custkey AS section, count(*) AS n_items, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1")
def items_by_section(spark, d):
    grouped = items(spark, d).groupBy("section").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return grouped.select("section", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


@query("SELECT coalesce(n_name, 'unknown') AS subdoc, count(*) AS n_items FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 0 GROUP BY 1")
def items_by_subdoc(spark, d):
    """Counts by section first, so that the joins see a row for each section and not for each item."""
    per = items(spark, d).groupBy("section").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("section"), "c_nationkey")
    n = table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return per.join(c, "section", "left").join(n, "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("unknown")).alias("subdoc")).agg(F.sum("n").alias("n_items"))


@query("SELECT o_orderkey AS id, o_orderpriority AS category, coalesce(pages, '') AS pages, coalesce(c_name, o_custkey::VARCHAR) AS section FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, string_agg((l_linenumber + 1)::VARCHAR, ',' ORDER BY l_linenumber) AS pages FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey")
def slim_items(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(tree.page_list(F.collect_set("l_linenumber"), 1 << 30).alias("pages"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("section"), "c_name")
    rows = items(spark, d).join(pages, "item", "left").join(c, "section", "left")
    return rows.select(F.col("item").alias("id"), "category", F.coalesce("pages", F.lit("")).alias("pages"), F.coalesce("c_name", F.col("section").cast("string")).alias("section"))


@query("SELECT section, kind::BIGINT AS kind, id, row_number() OVER (PARTITION BY section ORDER BY kind, id) AS ord FROM (SELECT c_custkey AS section, 0 AS kind, c_custkey AS id FROM customer UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders)")
def work_items_union(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("section"), F.lit(0).cast("long").alias("kind"), F.col("c_custkey").alias("id"))
    both = rows.unionByName(items(spark, d).select("section", F.lit(1).cast("long").alias("kind"), F.col("item").alias("id")))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("section").orderBy("kind", "id")).cast("long"))


@query("SELECT doc_id, source, printf('item-%04d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS item FROM documents")
def sequence_ids(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    return rows.withColumn("item", tree.numbered(rows, "source", ["doc_id"], "item-%04d"))


@query("SELECT o_orderkey AS item, o_orderpriority AS category FROM orders ORDER BY o_orderkey LIMIT 20")
def inspect_items(spark, d):
    """A listing of the first 20; the limit is the feature."""
    return items(spark, d).select("item", "category").orderBy("item").limit(20)


@query("SELECT o_orderkey AS item, coalesce(c_mktsegment, '') AS subdoc FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def join_section_subdoc(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("section"), "c_mktsegment")
    return items(spark, d).join(c, "section", "left").select("item", F.coalesce("c_mktsegment", F.lit("")).alias("subdoc"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'SECONDARY' ELSE 'PRIMARY' END AS priority FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0")
def filter_excluded(spark, d):
    priority = F.when(F.col("toxic") == 1, "EXCLUDED").when(F.col("quality") == 0, "SECONDARY").otherwise("PRIMARY")
    known = table(spark, d, "labels").select("doc_id", priority.alias("priority"))
    rows = table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("priority", F.lit("PRIMARY")).alias("priority"))
    return rows.where("priority <> 'EXCLUDED'")


# tree ---------------------------------------------------------------------------


@query(f"WITH RECURSIVE {CODES} SELECT node, code, level::BIGINT AS level FROM tr")
def wbs_codes(spark, d):
    return nodes(spark, d).select("node", "code", "level")


@query(f"WITH RECURSIVE {CODES}, {BRIDGE} SELECT (SELECT count(*) FROM orders) AS n_items, (SELECT count(*) FROM (SELECT item FROM br INTERSECT SELECT o_orderkey FROM orders)) AS attached, (SELECT count(DISTINCT item) FROM br) AS listed, (SELECT max(level) FROM tr)::BIGINT AS max_depth, (SELECT count(*) FROM tr) AS n_nodes")
def attachment_stats(spark, d):
    """Distinct attached ids, those that items have, and the tree's size."""
    listed = bridge(spark, d).select("item").distinct()
    known = listed.join(items(spark, d).select("item"), "item", "left_semi").agg(F.count("*").alias("attached"))
    size = nodes(spark, d).agg(F.max("level").alias("max_depth"), F.count("*").alias("n_nodes"))
    return items(spark, d).agg(F.count("*").alias("n_items")).crossJoin(known).crossJoin(listed.agg(F.count("*").alias("listed"))).crossJoin(size)  # one row each


@query(f"WITH {BRIDGE} SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM br WHERE item = o_orderkey)")
def orphan_items(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(bridge(spark, d).select(F.col("item").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")


@query(f"WITH {BRIDGE}, every AS (SELECT o_orderpriority AS category, o_orderkey FROM br JOIN orders ON o_orderkey = item UNION ALL SELECT o_orderpriority, o_orderkey FROM orders ANTI JOIN br ON item = o_orderkey), g AS (SELECT category, count(*) AS n, min(o_orderkey) AS first FROM every GROUP BY 1) SELECT category, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM g")
def category_histogram(spark, d):
    """Items in nodes, as often as they are attached, and orphans; the largest category first."""
    known = items(spark, d).select("item", "category")
    held = bridge(spark, d).groupBy("item").agg(F.count("*").alias("n"))
    counts = known.join(held, "item", "left").groupBy("category").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"), F.min("item").alias("first"))
    # one row a category; their order needs no window over all rows
    placed = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "category", "n"))).alias("g")).select(F.posexplode("g").alias("k", "g"))
    return placed.select("g.category", "g.n", (F.col("k") + 1).cast("long").alias("place"))


@query(f"WITH RECURSIVE {_ADJ}, {BRIDGE}, {_CLOSURE} SELECT a.node, coalesce(n, 0) AS n_items FROM adj a LEFT JOIN (SELECT above, count(*) AS n FROM cl JOIN br USING (node) GROUP BY 1) ON above = a.node")
def subtree_item_counts(spark, d):
    """Attached ids of a node and of all below it."""
    return tree.subtree_counts(tree.paths(adjacency(spark, d)), bridge(spark, d).select(F.lit("t").alias("doc"), "node")).select("node", "n_items")


@query(f"WITH RECURSIVE {_ADJ}, {BRIDGE}, {_CLOSURE} SELECT above AS node, o_orderpriority AS category, count(*) AS n FROM cl JOIN br USING (node) JOIN orders ON o_orderkey = item GROUP BY ALL")
def node_category_hist(spark, d):
    held = bridge(spark, d).join(items(spark, d).select("item", "category"), "item").select(F.lit("t").alias("doc"), "node", "category")
    return tree.subtree_counts(tree.paths(adjacency(spark, d)), held, ["category"]).select("node", "category", F.col("n_items").alias("n"))


@query("SELECT c_nationkey::BIGINT AS node, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS titles FROM customer GROUP BY 1")
def distinct_child_titles(spark, d):
    titles = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("titles"))
    return titles.select("node", F.array_join("titles", ",").alias("titles"))


@query(f"WITH {BRIDGE} SELECT coalesce(n_name, 'unknown') AS branch, o_custkey AS section, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey NOT IN (SELECT item FROM br) GROUP BY ALL")
def orphan_groups(spark, d):
    free = items(spark, d).join(bridge(spark, d).select("item").distinct(), "item", "left_anti").groupBy("section").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("section"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return free.join(c, "section", "left").join(n, "c_nationkey", "left").select(F.coalesce("n_name", F.lit("unknown")).alias("branch"), "section", "n")


@query("SELECT 'root' AS node, 'WBS Root' AS title, '' AS parent, '0' AS code, 'merged' AS origin UNION ALL SELECT 'n' || n_nationkey, n_name, 'root', row_number() OVER (ORDER BY n_nationkey)::VARCHAR, 'merged' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'n' || n_nationkey, n_name, '', 'old ' || n_nationkey, 'kept' FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def merge_preserved_nodes(spark, d):
    """New trees under one root; nodes kept by hand follow with their old codes unless their id was made again."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("title"))
    kept = n.where("ord % 2 = 0").withColumn("code", F.concat(F.lit("old "), "ord"))
    out = tree.merged(n.where("ord % 3 = 0").select(F.lit("t").alias("doc"), "node", F.lit("").alias("parent"), "ord", "title"), kept.select(F.lit("t").alias("doc"), "node", F.lit("").alias("parent"), "title", "code"), root="root")
    return out.select("node", "title", "parent", "code", "origin")


@query("WITH r AS (SELECT o_custkey AS section, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT section, 2::BIGINT AS level, section AS ref, count(*) AS n_items FROM r GROUP BY section UNION ALL SELECT section, 3, item, 1 FROM r WHERE r <= 20")
def localwbs_rule_tree(spark, d):
    return tree.rule_tree(items(spark, d).select("section", "item"))


@query(f"WITH RECURSIVE {CODES}, {BRIDGE}, f AS (SELECT * FROM tr WHERE code = '2.1.1' OR node = '2.1.1' ORDER BY ord, node LIMIT 1) SELECT f.code, f.title, br.item, coalesce(o_orderpriority, '') AS category FROM f LEFT JOIN br ON br.node = f.node LEFT JOIN orders ON o_orderkey = br.item")
def trace_node(spark, d):
    """The first node of that id or code, its items, blank where no item has the id."""
    found = nodes(spark, d).where("code = '2.1.1' or node = '2.1.1'").orderBy("ord", "node").limit(1)
    rows = found.join(bridge(spark, d), "node", "left").join(items(spark, d).select("item", "category"), "item", "left")
    return rows.select("code", "title", "item", F.coalesce("category", F.lit("")).alias("category"))


@query(f"WITH RECURSIVE {CODES} SELECT node, repeat('  ', level - 1) || CASE WHEN length(code) < 10 THEN rpad(code, 10, ' ') ELSE code END || ' ' || left(title, 50) AS line FROM tr")
def inspect_wbs(spark, d):
    line = F.concat(tree.padded(F.col("code"), 10), F.lit(" "), F.substring("title", 1, 50))
    return nodes(spark, d).select("node", tree.indented(line, (F.col("level") - 1).cast("int")).alias("line"))


# validation, exports --------------------------------------------------------------


_PAGES_OF = "CASE WHEN ord % 7 = 0 THEN [] ELSE list_transform(range(ord % 7), lambda x: x * 3 + ord % 5) END"
_ISSUES = f"""WITH RECURSIVE {PS}, {CODES}, {BRIDGE}, leaf AS (SELECT * FROM tr WHERE node NOT IN (SELECT parent FROM adj)),
 issue AS (SELECT 'structure' AS category, 'warning' AS severity, 'Node ' || node || ' has no parent' AS message, node, false AS needs_review FROM tr WHERE parent = ''
 UNION ALL SELECT 'source', 'info', 'EXPLICIT node ' || node || ' has no source pages', node, false FROM tr WHERE type = 'EXPLICIT' AND level > 1 AND ord % 7 = 0
 UNION ALL SELECT 'coverage', 'warning', count(*) || ' garbled pages not analyzed', '', true FROM ps WHERE c = 'G' HAVING count(*) > 0 UNION ALL SELECT 'coverage', 'info', count(*) || ' scanned pages not analyzed', '', false FROM ps WHERE c = 'I' HAVING count(*) > 0
 UNION ALL SELECT 'semantic', 'info', count(*) || ' leaf nodes have no work items', '', false FROM leaf WHERE node NOT IN (SELECT node FROM br) HAVING count(*) > 0)"""


def whole_nodes(spark, d) -> DataFrame:
    """The tree with source pages and work items."""
    held = bridge(spark, d).groupBy("node").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("work_items"))
    pages = F.when(F.col("ord") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("ord") % 7 - 1), lambda x: x * 3 + F.col("ord") % 5))
    return nodes(spark, d).withColumn("source_pages", pages).join(held, "node", "left")


def _issues(spark, d) -> DataFrame:
    quality = F.when(F.col("c") == "G", "GARBLED_TEXT").when(F.col("c") == "I", "IMAGE_ONLY").otherwise("NORMAL_TEXT")
    return validate.issues(whole_nodes(spark, d), page_states(spark, d).select(quality.alias("quality")))


@query(f"{_ISSUES} SELECT * FROM issue")
def validate_wbs(spark, d):
    return _issues(spark, d)


@query(f"{_ISSUES} SELECT count(*) AS issues, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (severity = 'error') = 0 AS passed FROM issue")
def validation_report(spark, d):
    return validate.report(_issues(spark, d))


@query(f"WITH RECURSIVE {SEG}, {CODES} SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM ps WHERE c = 'G') AS garbled, (SELECT count(*) FROM ps WHERE c = 'I') AS image_only, (SELECT count(*) FROM seg) AS subdocs, (SELECT count(*) FROM ps WHERE c = 'N') AS sections, (SELECT count(*) FROM part WHERE regexp_matches(p_name, '[0-9]')) AS captioned_tables, (SELECT count(*) FROM tr) AS nodes")
def coverage_report(spark, d):
    pages = page_states(spark, d).agg(F.count("*").alias("pages"), F.count_if(F.col("c") == "G").alias("garbled"), F.count_if(F.col("c") == "I").alias("image_only"), F.count_if(F.col("c") == "N").alias("sections"))
    named = table(spark, d, "part").where(F.col("p_name").rlike("[0-9]")).agg(F.count("*").alias("captioned_tables"))
    return pages.crossJoin(runs(spark, d).agg(F.count("*").alias("subdocs"))).crossJoin(named).crossJoin(nodes(spark, d).where("level > 0").agg(F.count("*").alias("nodes")))  # one row each


@query(f"WITH {SEG} SELECT doc, seq, CASE WHEN length(label || ' run') < 20 THEN rpad('  ' || label || ' run', 22, ' ') ELSE '  ' || label || ' run' END || '  p' || (start_page + 1) || '-p' || (end_page + 1) || '  (' || (end_page - start_page + 1) || 'p)  [' || label || ']' AS line FROM seg")
def coverage_subdoc_lines(spark, d):
    rows = runs(spark, d)
    line = F.format_string("  %s  p%d-p%d  (%dp)  [%s]", tree.padded(F.concat("label", F.lit(" run")), 20), F.col("start_page") + 1, F.col("end_page") + 1, F.col("end_page") - F.col("start_page") + 1, "label")
    return rows.select("doc", "seq", line.alias("line"))




@query(f"WITH RECURSIVE {CODES}, {BRIDGE}, n AS (SELECT node, count(*) AS n FROM br GROUP BY 1) SELECT code AS \"Code\", repeat('  ', level - 1) || title AS \"Title\", level::BIGINT AS \"Level\", type AS \"Type\", coalesce(n, 0)::BIGINT AS \"Work Items\", array_to_string(list_transform(({_PAGES_OF})[1:5], lambda p: p + 1), ',') AS \"Source Pages\" FROM tr LEFT JOIN n USING (node)")
def export_csv_rows(spark, d):
    rows = export.csv_rows(whole_nodes(spark, d))
    return rows.drop("ord").withColumn("Work Items", F.greatest("Work Items", F.lit(0)).cast("long"))


@query(f"WITH RECURSIVE {CODES} SELECT code, '{{\"code\":\"' || code || '\",\"title\":\"' || title || '\",\"level\":' || level || ',\"parent\":\"' || parent || '\"}}' AS json FROM tr")
def export_json_rows(spark, d):
    return nodes(spark, d).select("code", F.to_json(F.struct("code", "title", "level", "parent")).alias("json"))


@query(f"WITH RECURSIVE {CODES} SELECT ord, repeat('    ', level) || code || ' ' || replace(replace(replace(replace(title, '(', ''), ')', ''), '[', ''), ']', '') AS line FROM tr")
def export_mermaid_lines(spark, d):
    return export.mermaid_rows(nodes(spark, d))


_SLIM = "'{\"id\":\"' || o_orderkey || '\",\"desc\":\"' || o_orderstatus || '<\\/\",\"cat\":\"' || o_orderpriority || '\",\"pages\":[' || (o_custkey % 9 + 1) || '],\"sec\":\"' || coalesce(c_name, o_custkey::VARCHAR) || '\"}'"


@query(f"WITH RECURSIVE {CODES}, {BRIDGE} SELECT tr.node, coalesce('[' || string_agg({_SLIM}, ',' ORDER BY item::VARCHAR) FILTER (o_orderkey IS NOT NULL) || ']', '[]') AS items FROM tr LEFT JOIN br USING (node) LEFT JOIN orders ON o_orderkey = item LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 6 <> 0 GROUP BY 1")
def html_payload_nodes(spark, d):
    """Each node's items in order; ids that no item has are left out."""
    found = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.lit("").alias("subdoc_id"), F.col("o_custkey").cast("string").alias("section_id"), F.col("o_orderpriority").alias("category"), F.concat("o_orderstatus", F.lit("</")).alias("description"), F.array(F.col("o_custkey") % 9).alias("source_pages"))
    sections = table(spark, d, "customer").where("c_custkey % 6 <> 0").select(F.col("c_custkey").cast("string").alias("section_id"), F.col("c_name").alias("title"))
    none = sections.select(F.col("section_id").alias("subdoc_id"), "title").limit(0)
    whole = whole_nodes(spark, d).withColumnsRenamed({"node": "node_id", "parent": "parent_id"})
    payload, _, _ = export.payload(whole, found, sections, none)
    return payload.select(F.col("node.id").alias("node"), F.replace(F.to_json("node.items"), F.lit("</"), F.lit("<\\/")).alias("items"))
