"""Commands on projects: init, ingest, status, run, auto, rerun, inspect, export, goldtest.

``python -m leafweave.engine.cli COMMAND ...``.  Exit codes: 0 done, 2 done but
something needs review, 3 failed.
"""

from __future__ import annotations

import argparse
import importlib
import shutil
import subprocess
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.engine import stages
from leafweave.engine.manifest import STAGES, Manifest, file_hash
from leafweave.operators import tree
from leafweave.sources import files

DONE, REVIEW, FAILED = 0, 2, 3
SETTINGS = '[llm]\nbase_url = "http://localhost:8000/v1"\nmock = true\nmax_retries = 3\ntemperature_wbs = 0.1\n\n[layout]\nheader_band = 0.12\nfooter_band = 0.12\nmin_consecutive_pages = 2\n\n[table]\nmerge_confidence_min = 0.80\n\n[source]\n# for PDF files: a function of (name, bytes) to pages, as module:function\ndecoder = ""\n'
VIEWS = ("pages", "subdocs", "sections", "tables", "items", "wbs", "issues", "trace")


class Failed(Exception):
    """A command can't be carried out; the message says why."""


class Engine:
    """Projects below a folder."""

    def __init__(self, home: str | Path = ".", spark: SparkSession | None = None) -> None:
        self.home, self._spark = Path(home), spark

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return self._spark

    def folder(self, project: str, must: bool = True) -> Path:
        path = self.home / "data" / "projects" / project
        if must and not path.exists():
            raise Failed(f"no such project: {project}")
        return path

    def init(self) -> bool:
        """Settings and folders; true if the settings are new."""
        (self.home / "data" / "projects").mkdir(parents=True, exist_ok=True)
        path = self.home / files.SETTINGS[0]
        if path.exists():
            return False
        path.write_text(SETTINGS, encoding="utf-8")
        return True

    def ingest(self, source: str | Path, project: str = "") -> str:
        """Copies a source (a PDF, or decoded pages as Parquet or JSON lines) once and makes its records; the project's name."""
        source = Path(source).resolve()
        if not source.exists():
            raise Failed(f"no such file: {source}")
        project = project or f"{source.stem}_{date.today().isoformat()}"
        to = self.folder(project, must=False) / "original" / ("source" + source.suffix)
        to.parent.mkdir(parents=True, exist_ok=True)
        if not to.exists():
            shutil.copytree(source, to) if source.is_dir() else shutil.copy2(source, to)
        m = Manifest(self.folder(project))
        m.project, m.source_hash = project, _hash(to)
        m.save()
        return project

    def _context(self, project: str) -> stages.Context:
        config = files.settings(self.home)
        return stages.Context(self.spark, self.folder(project), config, lambda: self._pages(project, config))

    def _pages(self, project: str, config: dict) -> DataFrame:
        found = sorted((self.folder(project) / "original").iterdir())
        if not found:
            raise Failed("the project has no source")
        path = found[0]
        if path.suffix == ".parquet":
            return self.spark.read.schema(files.PAGE).parquet(str(path))
        if path.suffix in (".jsonl", ".json"):
            return files.json_lines(self.spark, str(path), files.PAGE)
        name = config.get("source", {}).get("decoder", "")
        if not name:
            raise Failed("no decoder is set for this kind of file")
        module, _, function = name.partition(":")
        return files.decoded(self.spark, str(path), getattr(importlib.import_module(module), function))

    def status(self, project: str) -> DataFrame:
        return Manifest(self.folder(project)).table(self.spark).select("ordinal", "stage", "status", "finished_at")

    def run(self, project: str, from_: str = "", to: str = "", stage: str = "", force: bool = False) -> int:
        """Runs stages in order, from the first that isn't done unless told otherwise; skips those done on the same inputs."""
        m = Manifest(self.folder(project))
        for name in (from_, to, stage):
            if name and name not in STAGES:
                raise Failed(f"no such stage: {name}")
        begin = from_ or ("" if force else m.pending() or "")
        todo = [stage] if stage else STAGES[STAGES.index(begin) if begin else 0 : STAGES.index(to) + 1 if to else None]
        context, review = self._context(project), False
        for name in todo:
            if not m.skips(name, force):
                m.mark_running(name)
                try:
                    stages.run(context, name)
                except Exception as e:  # whatever a stage raises is recorded and ends the run
                    m.mark_failed(name, str(e))
                    print(f"stage {name} failed: {e}", file=sys.stderr)
                    return FAILED
                m.mark_done(name)
            if name == "validate":  # also where the stage was skipped: its report still holds
                review = context.read("validate", "report").first()["needs_review"] > 0
        return REVIEW if review else DONE

    def rerun(self, project: str, stage: str) -> int:
        """Runs one stage again; what is done behind it becomes stale."""
        code = self.run(project, stage=stage, force=True)
        Manifest(self.folder(project)).mark_downstream_stale(stage)
        return code

    def export(self, project: str) -> list[str]:
        """All formats again; the files."""
        if self.run(project, stage="export", force=True) == FAILED:
            raise Failed("the export failed")
        return sorted(str(p) for p in (self.folder(project) / "exports").iterdir())

    def auto(self, source: str | Path) -> tuple[str, int]:
        """Ingests a source and runs everything."""
        project = self.ingest(source)
        return project, self.run(project)

    def inspect(self, project: str, view: str, node: str = "") -> DataFrame:
        """One of the read-only views."""
        c = self._context(project)
        pages = F.format_string("p%d-p%d", F.col("start_page") + 1, F.col("end_page") + 1).alias("pages")
        if view == "pages":
            return c.read("quality", "summary")
        if view == "subdocs":
            return c.read("subdoc", "subdocs").orderBy("doc", "seq").select("subdoc_id", "title", "doc_type", pages)
        if view == "sections":
            return c.read("section", "sections").orderBy("doc", "section").select("section_id", "subdoc_id", F.substring("title", 1, 40).alias("title"), pages)
        if view == "tables":
            span = F.format_string("p%d-p%d", F.col("page_start") + 1, F.col("page_end") + 1).alias("pages")
            return c.read("table", "tables").where("caption <> ''").orderBy("doc", "table").select(F.format_string("tbl-%03d", "table").alias("table_id"), F.substring("caption", 1, 30).alias("caption"), span, F.size("rows").alias("n_rows"), "cross_page")
        if view == "items":
            return c.read("extract", "items").orderBy("doc", "ord").limit(20).select("item_id", F.substring("description", 1, 60).alias("description"))
        if view == "wbs":
            line = F.concat(tree.padded(F.col("code"), 10), F.lit(" "), F.substring("title", 1, 50))
            return c.read("merge", "nodes").where("level > 0").orderBy("doc", "ord").select(tree.indented(line, (F.col("level") - 1).cast("int")).alias("line"))
        if view == "issues":
            return c.read("validate", "issues").select("severity", "message")
        if view == "trace":
            if not node:
                raise Failed("trace needs a node")
            found = c.read("merge", "nodes").where((F.col("node") == node) | (F.col("code") == node)).orderBy("ord").limit(1)
            held = found.select("code", "title", "level", "type", F.transform("source_pages", lambda p: p + 1).alias("pages"), F.explode_outer("work_items").alias("item_id"))
            return held.join(c.read("extract", "items").select("item_id", F.substring("description", 1, 60).alias("description")), "item_id", "left")
        raise Failed(f"no such view: {view}")

    def goldtest(self, source: str, tests: str = "tests") -> int:
        """Runs the tests, if the source that they are about exists."""
        if not Path(source).exists():
            raise Failed(f"no such file: {source}")
        return subprocess.run([sys.executable, "-m", "pytest", tests, "-q"], check=False).returncode


def _hash(path: Path) -> str:
    if path.is_file():
        return file_hash(path)
    import hashlib

    parts = [f"{p.name} {file_hash(p)}" for p in sorted(path.rglob("*")) if p.is_file()]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="leafweave")
    top.add_argument("--home", default=".")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    p = sub.add_parser("ingest")
    p.add_argument("source")
    p.add_argument("--project", default="")
    sub.add_parser("status").add_argument("project")
    p = sub.add_parser("run")
    p.add_argument("project")
    for name in ("--from", "--to", "--stage"):
        p.add_argument(name, default="", dest=name.strip("-").replace("from", "from_"))
    p.add_argument("--force", action="store_true")
    sub.add_parser("auto").add_argument("source")
    p = sub.add_parser("rerun")
    p.add_argument("project")
    p.add_argument("--stage", required=True)
    p = sub.add_parser("inspect")
    p.add_argument("project")
    p.add_argument("view", choices=VIEWS)
    p.add_argument("--id", default="")
    sub.add_parser("export").add_argument("project")
    sub.add_parser("goldtest").add_argument("source")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    engine = Engine(a.home, spark)
    try:
        if a.command == "init":
            print("created" if engine.init() else "exists already")
        elif a.command == "ingest":
            print(engine.ingest(a.source, a.project))
        elif a.command == "status":
            engine.status(a.project).show(len(STAGES), truncate=False)
        elif a.command == "run":
            return engine.run(a.project, a.from_, a.to, a.stage, a.force)
        elif a.command == "auto":
            project, code = engine.auto(a.source)
            print(project)
            if code != FAILED:
                engine.inspect(project, "pages").show()
                print(*sorted((engine.folder(project) / "exports").iterdir()), sep="\n")
            return code
        elif a.command == "rerun":
            return engine.rerun(a.project, a.stage)
        elif a.command == "inspect":
            engine.inspect(a.project, a.view, a.id).show(1000, truncate=False)
        elif a.command == "export":
            print(*engine.export(a.project), sep="\n")
        else:
            return engine.goldtest(a.source)
    except Failed as e:
        print(e, file=sys.stderr)
        return FAILED
    return DONE


if __name__ == "__main__":
    sys.exit(main())
