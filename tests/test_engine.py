"""A whole document through all stages, and the parts that no query shows: files, settings, model calls, records, commands."""

import csv
import json
import zipfile

import pytest

from leafweave.engine import cli, manifest, stages
from leafweave.model import client as model
from leafweave.operators import labels, segments, tree
from leafweave.sinks import export
from leafweave.sources import files

HEIGHT = 800.0


def block(ord_, text, y0=300.0, size=11.0, kind=0):
    spans = [{"text": text, "font": "kai", "size": size, "bold": size > 12}]
    return {"kind": kind, "ord": ord_, "x0": 0.0, "y0": y0, "x1": 500.0, "y1": y0 + 12, "lines": [spans]}


def page(n, *blocks, images=0, tables=()):
    fonts = [{"name": "kai", "encoding": "Identity-H", "definition": "<< /ToUnicode 5 0 R >>" if n else "<< >>"}]
    return {"doc": "c.pdf", "page": n, "width": 600.0, "height": HEIGHT, "image_count": images, "fonts": fonts, "blocks": list(blocks), "tables": [[[c for c in r] for r in t] for t in tables]}


HEAD = ["項次", "項目", "需求 說明"]


def document():
    """Contract 0-3, attachments 4-5, signatures 6, requirements 7-11, bid instructions 12-13, scanned 14, garbled 15."""
    out = [page(0, block(0, "第一條 履約標的", size=14.0), block(1, "本契約之標的如附件。"), block(2, "第二條 契約價金之給付", size=14.0), block(3, "按季付款。"))]
    out += [page(n, block(0, f"契約條文第{n}頁內容")) for n in (1, 2, 3)]
    out += [page(4, block(0, "附件1：保密切結書", size=16.0), block(1, "不得洩漏。")), page(5, block(0, "附件續頁"))]
    out += [page(6, block(0, "立 契約人"), block(1, "甲方"))]
    out += [page(7, block(0, "目 錄"), block(1, "壹、專案目標 ........ 8"), block(2, "（一）範圍 ··· 9"))]
    out += [page(8, block(0, "壹、專案目標", size=16.0), block(1, "目標說明"), block(2, "貳、維運服務", size=16.0), block(3, "每月維運"))]
    out += [page(9, block(0, "表 5  需求清單"), tables=[[HEAD, ["1", " 系統 ", "查詢"], ["2", None, "報表"]]])]
    out += [page(10, block(0, "續表"), tables=[[HEAD, ["3", "介面", "匯出"], HEAD]]), page(11, block(0, "維運結束"))]
    out += [page(n, block(0, "一、投標文件", size=12.0), block(1, f"投標須知 第 {n} 頁", y0=780.0)) for n in (12, 13)]
    out += [page(14, images=1), page(15, block(0, "xxxx yyyy"))]
    for k, x in enumerate(out[8:12]):  # a running header on four pages
        x["blocks"].append(block(9, f"需求規範 {k}", y0=10.0))
    return out


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    source = home / "contract.jsonl"
    source.write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in document()), encoding="utf-8")
    engine = cli.Engine(home, spark)
    assert engine.init() and not engine.init()
    name = engine.ingest(source, "one")
    assert engine.run(name) == cli.REVIEW  # garbled pages
    return engine, name


def rows(engine, name, stage, table, *columns):
    return [tuple(r) for r in engine._context(name).read(stage, table).select(*columns).collect()]


def test_pages_and_labels(project):
    engine, name = project
    quality = dict(rows(engine, name, "quality", "pages", "page", "quality"))
    assert [quality[p] for p in range(16)] == ["NORMAL_TEXT"] * 14 + ["IMAGE_ONLY", "GARBLED_TEXT"] or quality[14] == "GARBLED_TEXT"
    runs = sorted(rows(engine, name, "subdoc", "subdocs", "start_page", "end_page", "doc_type", "title"))
    assert runs[:5] == [(0, 3, "CONTRACT_BODY", "契約本文"), (4, 5, "ATTACHMENT", "附件"), (6, 6, "SIGNATURE_PAGE", "簽署頁"), (7, 11, "REQUIREMENT_SPECIFICATION", "需求規範書"), (12, 13, "BID_INSTRUCTIONS", "投標須知")]
    assert sorted(set(rows(engine, name, "layout", "families", "role", "pattern"))) == [("RUNNING_FOOTER", "投標須知 第 {n} 頁"), ("RUNNING_HEADER", "需求規範 {n}")]
    assert rows(engine, name, "parse", "fonts", "name", "has_tounicode") == [("kai", False)]


def test_contents_sections_tables(project):
    engine, name = project
    assert sorted(rows(engine, name, "toc", "entries", "title", "printed_page", "level")) == [("壹、專案目標", 8, 1), ("範圍", 9, 2)]
    found = sorted(rows(engine, name, "section", "sections", "section", "title", "start_page", "end_page"))
    assert found[:5] == [(1, "第一條 履約標的", 0, 0), (2, "第二條 契約價金之給付", 0, 3), (3, "附件1：保密切結書", 4, 5), (4, "壹、專案目標", 8, 8), (5, "貳、維運服務", 8, 11)]
    (table,) = engine._context(name).read("table", "tables").collect()
    assert (table.page_start, table.page_end, table.caption, table.header, table.cross_page, table.confidence, table.section) == (9, 10, "表5 需求清單", HEAD, True, 0.95, 5)
    assert table.rows == [["1", "系統", "查詢"], ["2", "", "報表"], ["3", "介面", "匯出"]]
    text = dict(rows(engine, name, "assemble", "markdown", "section", "markdown"))[5]
    assert text.startswith("# 貳、維運服務\n\n壹、專案目標\n\n目標說明\n") and text.count("| 項次 | 項目 | 需求 說明 |") == 1 and "\n表 5  需求清單\n\n| 項次" in text and "需求規範" not in text


def test_classes_items_tree(project):
    engine, name = project
    classes = {r[0]: r[1:] for r in rows(engine, name, "classify", "classes", "section", "category", "rule_category", "priority")}
    assert classes[2] == ("PAYMENT", "PAYMENT", "SECONDARY") and classes[5] == ("MAINTENANCE", "MAINTENANCE", "PRIMARY") and classes[3] == ("SCOPE", "UNCLASSIFIED", "SECONDARY")
    assert all(p == "EXCLUDED" for s, (_, _, p) in classes.items() if s > 5)
    items = sorted(rows(engine, name, "extract", "items", "item_id", "section", "description", "category", "source_pages"))
    assert [i[2] for i in items if i[1] == 5] == ["1 | 系統 | 查詢", "2 | 報表", "3 | 介面 | 匯出", "mock_title"]
    assert [i[0] for i in items] == [f"item-{k:04d}" for k in range(1, len(items) + 1)] and not any(i[1] > 5 for i in items)
    nodes = engine._context(name).read("merge", "nodes").orderBy("ord").collect()
    assert nodes[0].node == "wbs-root" and nodes[0].code == "0"
    assert len({n.node for n in nodes}) == len(nodes) and {n.parent for n in nodes} <= {n.node for n in nodes} | {""}
    assert {n.level for n in nodes} == {0, 1, 2, 3} and all(n.code.count(".") == n.level - 1 for n in nodes if n.level > 0)
    report = engine._context(name).read("validate", "report").first()
    assert report.passed and report.needs_review == 1
    assert rows(engine, name, "relate", "relations", "relation_type")[0] == ("depends_on",)


def test_exports(project):
    engine, name = project
    folder = engine.folder(name) / "exports"
    (table,) = folder.glob("*.csv")
    with open(table, encoding="utf-8", newline="") as f:
        lines = list(csv.reader(f))
    assert tuple(lines[0]) == export.HEADER and lines[1][0] == "1" and lines[1][2] == "1" and any(x[1].startswith("    ") for x in lines)
    (held,) = folder.glob("*.json")
    nodes = json.loads(held.read_text(encoding="utf-8"))
    assert nodes[0]["node_id"] == "wbs-root" and len(nodes) == len(lines)
    (mind,) = folder.glob("*.mmd")
    assert mind.read_text(encoding="utf-8").startswith("mindmap\n  root((WBS))\n    1 ")
    (sheet,) = folder.glob("*.xlsx")
    with zipfile.ZipFile(sheet) as z:
        text = z.read("xl/worksheets/sheet1.xml").decode("utf-8")
    assert text.count("<row ") == len(lines) and '<c r="A1" t="inlineStr" s="1">' in text
    assert "Total pages:    16" in (folder / "coverage.txt").read_text(encoding="utf-8") and "  契約本文" in (folder / "coverage.txt").read_text(encoding="utf-8")
    (report,) = folder.glob("*.html")
    assert '"id": "wbs-root"' in report.read_text(encoding="utf-8")
    assert len(list((folder / "sections").glob("*.md"))) == len(rows(engine, name, "section", "sections", "section"))


def test_records_and_commands(project, spark, capsys):
    engine, name = project
    m = manifest.Manifest(engine.folder(name))
    assert m.pending() is None and all(r.status == "DONE" for r in m.records.values())
    before = m.records["quality"].finished_at
    assert engine.run(name) == cli.REVIEW and manifest.Manifest(engine.folder(name)).records["quality"].finished_at == before
    home = ["--home", str(engine.home)]
    assert cli.main([*home, "rerun", name, "--stage", "relate"], spark) == cli.DONE
    states = {s: r.status for s, r in manifest.Manifest(engine.folder(name)).records.items()}
    assert states["relate"] == "DONE" and states["extract"] == "DONE" and {states[s] for s in ("localwbs", "merge", "validate", "export")} == {"STALE"}
    assert cli.main([*home, "run", name, "--to", "validate"], spark) == cli.REVIEW
    assert manifest.Manifest(engine.folder(name)).pending() == "export"
    for view in cli.VIEWS:
        assert cli.main([*home, "inspect", name, view, "--id", "1"], spark) == cli.DONE
    assert cli.main([*home, "status", name], spark) == cli.DONE
    assert "STALE" in capsys.readouterr().out
    assert cli.main([*home, "status", "none"], spark) == cli.FAILED and cli.main([*home, "run", name, "--stage", "nothing"], spark) == cli.FAILED
    assert cli.main([*home, "inspect", name, "trace"], spark) == cli.FAILED and cli.main([*home, "ingest", "/no/such"], spark) == cli.FAILED
    assert cli.main([*home, "export", name], spark) == cli.DONE


def test_a_failed_stage_is_recorded(spark, tmp_path):
    engine = cli.Engine(tmp_path, spark)
    source = tmp_path / "x.pdf"
    source.write_bytes(b"%PDF")
    name = engine.ingest(source)
    assert engine.run(name) == cli.FAILED
    m = manifest.Manifest(engine.folder(name))
    assert m.records["parse"].status == "FAILED" and "decoder" in m.records["parse"].error and m.source_hash == manifest.file_hash(source)


def test_binary_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"hello")
    given = {k: v for k, v in page(0, block(0, "?"), block(1, "picture", kind=1)).items() if k != "doc"}

    def decoder(name, content):
        given["blocks"][0]["lines"][0][0]["text"] = content.decode()
        return [given]

    pages = files.decoded(spark, str(tmp_path), decoder)
    assert [(r.doc, r.block_id, r.text) for r in files.blocks_of(pages).collect()] == [("a.pdf", "p0001-b000", "hello")]


def test_json_sources_and_settings(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    for n in (2, 10, 1):
        (pages / f"p{n:04d}.json").write_text(json.dumps({"page": n, "text": "頁"}, ensure_ascii=False), encoding="utf-8")
    (pages / "other.json").write_text("{}")
    assert [r.page for r in files.folder_rows(spark, str(pages), "page long, text string").collect()] == [1, 2, 10]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "a long").where("a is not null").collect()) == [1, 2]
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 3}]')
    assert sorted(r.a for r in files.json_rows(spark, str(tmp_path / "a.json"), "a long").collect()) == [1, 3]
    (tmp_path / "wbs.toml").write_text('[llm]\nmock = false\nmodel = "m"\n[new]\nx = 1\n')
    (tmp_path / "wbs.local.toml").write_text('[llm]\nmodel = "own"\n')
    got = files.settings(tmp_path)
    assert got["llm"]["model"] == "own" and got["llm"]["mock"] is False and got["llm"]["max_retries"] == 3 and got["new"] == {"x": 1} and files.DEFAULTS["llm"]["mock"] is True
    assert all('"' in files.prompt(f"{n}_v1") for n in ("classify", "extract", "relate", "localwbs", "merge", "validate"))
    export.write_json(spark.createDataFrame([(1, "頁")], "a int, b string"), str(tmp_path / "o.json"), lines=False)
    assert json.loads((tmp_path / "o.json").read_text(encoding="utf-8")) == [{"a": 1, "b": "頁"}]
    export.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "lines"))
    held = len(list((tmp_path / "lines").glob("*.json")))
    assert held and export.purge(tmp_path / "lines") == held and not list((tmp_path / "lines").glob("*.json")) and export.purge(tmp_path / "none") == 0


def test_model_client(spark):
    schema = {"type": "object", "properties": {"c": {"type": "string", "enum": ["X", "Y"]}, "n": {"type": "integer"}, "f": {"type": "number"}, "b": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "string"}}, "t": {"type": "string"}}}
    assert model.Client().generate("s", "u", schema) == {"c": "X", "n": 1, "f": 1.0, "b": True, "l": ["mock_l_item"], "t": "mock_t"} and model.Client().generate("s", "u") == {"result": "mock"}
    slept, calls = [], []

    def flaky(system, user, temperature):
        calls.append(user)
        return '{"a": 1}' if len(calls) > 2 else "no json"

    assert model.Client(mock=False, call=flaky, sleep=slept.append).generate("s", "u") == {"a": 1} and slept == [1, 2]
    with pytest.raises(model.CallFailed):
        model.Client(mock=False, tries=5, call=lambda *a: "", sleep=slept.append).generate("s", "u")
    assert slept[2:] == [1, 2, 4, 8, 8]
    # a text that is too long for the model is halved at a line end; what fails at the least size is told
    short = model.Client(mock=False, tries=1, call=lambda s, u, t: json.dumps({"w": [len(u)]}) if len(u) < 700 and "bad" not in u else "", sleep=lambda s: None)
    text = "a" * 590 + "\n" + "b" * 600
    assert short.generate_halving("s", text, {}, "w") == ([590, 600], [])
    found, lost = short.generate_halving("s", "x" * 600 + "\n" + "bad" + "y" * 480, {}, "w")
    assert found == [600] and lost == ["bad" + "y" * 480]
    prompts = spark.createDataFrame([(1, "u"), (2, None)], "id int, user string")
    got = model.answers(prompts, model.Client(), "s", schema).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2] and json.loads(got[0].output)["c"] == "X" and got[0].mock and got[0].input_length == 1
    assert got[0].input_hash == prompts.select(model.input_hash(model.F.lit("s"), model.F.lit("u"))).first()[0]


def test_golden_segments(spark):
    """The published segmentation of a 309-page document, from pages with the signs that decide it."""
    n, text = 309, {0: "第一條 總則", 48: "附件1 切結", 64: "立契約人", 147: "公開招標公告"}
    quality = ["NORMAL_TEXT"] * 153 + ["IMAGE_ONLY"] * 10 + ["NORMAL_TEXT"] * 11 + ["GARBLED_TEXT"] * 135
    text |= {p: "│法規│" for p in range(163, 174)}
    pages = spark.createDataFrame([("g", p, quality[p]) for p in range(n)], "doc string, page long, quality string")
    blocks = spark.createDataFrame([("g", p, 0, text.get(p, "內容"), 16.0) for p in range(n)], "doc string, page long, ord long, text string, font_size double")
    family = [("g", 1, "RUNNING_FOOTER", "投標須知 {n}", p) for p in range(93, 126)] + [("g", 2, "RUNNING_HEADER", "{n}/{n}/{n} 評選", p) for p in range(130, 140)]
    families = spark.createDataFrame(family, "doc string, family int, role string, pattern string, page long")
    runs = segments.run_length(labels.page_labels(pages, blocks, families).select("doc", "page", "label")).orderBy("seq").collect()
    assert [(r.label, r.start_page, r.end_page) for r in runs] == [
        ("CONTRACT_BODY", 0, 47), ("ATTACHMENT", 48, 63), ("SIGNATURE_PAGE", 64, 64), ("REQUIREMENT_SPECIFICATION", 65, 92), ("BID_INSTRUCTIONS", 93, 125),
        ("EVALUATION_GUIDELINES", 126, 146), ("TENDER_ANNOUNCEMENT", 147, 152), ("SCANNED_PAGES", 153, 162), ("LAW_OR_POLICY", 163, 173), ("SERVICE_PROPOSAL", 174, 308),
    ]


def test_tree_cycle_and_depth(spark):
    chain = [("d", f"n{k}", f"n{k - 1}" if k else "", k) for k in range(37)]
    got = {r.node: r for r in tree.paths(spark.createDataFrame(chain, "doc string, node string, parent string, ord long")).collect()}
    assert got["n36"].code == ".".join(["1"] * 37) and got["n36"].depth == 37 and set(got["n36"].above) == set(got)
    loop = spark.createDataFrame([("d", "a", "b", 1), ("d", "b", "a", 2)], "doc string, node string, parent string, ord long")
    with pytest.raises(ValueError):
        tree.paths(loop, most_rounds=3)
    assert stages.STAGES[0] == "parse"
