"""Stage records: which stages of a project ran, on what, and what is due.

Records are rows (project, ordinal, stage, status, input_hash, started_at,
finished_at, error).  The rules are columns and filters over such a table;
``Manifest`` keeps one project's fifteen rows in a JSON file.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The stages in their order, and a record's states.
STAGES = ("parse", "quality", "layout", "subdoc", "toc", "section", "table", "assemble", "classify", "extract", "relate", "localwbs", "merge", "validate", "export")
PENDING, RUNNING, DONE, FAILED, STALE = "PENDING", "RUNNING", "DONE", "FAILED", "STALE"


def should_skip(status: Column, input_hash: Column, now: Column, force: bool = False) -> Column:
    """True where a stage is done on the same inputs."""
    return F.lit(False) if force else F.coalesce((status == DONE) & (input_hash == now), F.lit(False))


def first_pending(records: DataFrame) -> DataFrame:
    """(project, pending): the first ordinal that isn't done, of projects that have one."""
    return records.where(F.col("status") != DONE).groupBy("project").agg(F.min("ordinal").alias("pending"))


def downstream_stale(records: DataFrame, ordinal: int) -> DataFrame:
    """Done stages behind one become stale; others keep their state."""
    return records.withColumn("status", F.when((F.col("ordinal") > ordinal) & (F.col("status") == DONE), STALE).otherwise(F.col("status")))


def file_hash(path: str | Path) -> str:
    """SHA-256 of a file, read a piece at a time."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass
class Record:
    status: str = PENDING
    input_hash: str = ""
    started_at: str = ""
    finished_at: str = ""
    error: str = ""
    output_files: list[str] = field(default_factory=list)


class Manifest:
    """One project's records; every change is written at once."""

    def __init__(self, folder: str | Path) -> None:
        self.path = Path(folder) / "manifest.json"
        self.project, self.source_hash = Path(folder).name, ""
        self.records = {s: Record() for s in STAGES}
        if self.path.exists():
            held = json.loads(self.path.read_text(encoding="utf-8"))
            self.project, self.source_hash = held.get("project", self.project), held.get("source_hash", "")
            self.records |= {s: Record(**r) for s, r in held.get("stages", {}).items() if s in self.records}

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        held = {"project": self.project, "source_hash": self.source_hash, "stages": {s: asdict(r) for s, r in self.records.items()}}
        self.path.write_text(json.dumps(held, ensure_ascii=False, indent=2), encoding="utf-8")

    def input_hash(self, stage: str) -> str:
        """Of a stage: its name, the source and when the stage before it was finished."""
        k = STAGES.index(stage)
        before = self.records[STAGES[k - 1]].finished_at if k else ""
        return hashlib.sha256((stage + self.source_hash + before).encode()).hexdigest()

    def skips(self, stage: str, force: bool = False) -> bool:
        r = self.records[stage]
        return not force and r.status == DONE and r.input_hash == self.input_hash(stage)

    def mark_running(self, stage: str) -> None:
        r = self.records[stage]
        r.status, r.input_hash, r.started_at, r.error = RUNNING, self.input_hash(stage), now(), ""
        self.save()

    def mark_done(self, stage: str, files: list[str] | None = None) -> None:
        r = self.records[stage]
        r.status, r.finished_at, r.output_files = DONE, now(), files or r.output_files
        self.save()

    def mark_failed(self, stage: str, error: str) -> None:
        r = self.records[stage]
        r.status, r.finished_at, r.error = FAILED, now(), error
        self.save()

    def mark_downstream_stale(self, stage: str) -> None:
        for later in STAGES[STAGES.index(stage) + 1 :]:
            if self.records[later].status == DONE:
                self.records[later].status = STALE
        self.save()

    def pending(self) -> str | None:
        """The first stage that isn't done."""
        return next((s for s in STAGES if self.records[s].status != DONE), None)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.project, k, s, r.status, r.input_hash, r.started_at, r.finished_at, r.error) for k, (s, r) in enumerate(self.records.items(), 1)]
        return spark.createDataFrame(rows, "project string, ordinal long, stage string, status string, input_hash string, started_at string, finished_at string, error string")
