"""The job service: a registry of builds as tables, and its requests over HTTP.

Jobs, their log lines and their outcomes are rows appended under one folder that any
Spark file system reaches; a listing is a query over them, so many writers need no lock.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import clean_text, coerce_bool
from quire.plans import jobs

JOB = "job_id string, epub string, out_name string, title string, options string, created double"
LINE = "job_id string, seq long, line string"
OUTCOME = "job_id string, status string, pdf string, artifacts string, error string, finished double"
#: What a request may say, with its default; true-words; endings of files that are handed out.
FORM = {
    "title": "", "author": "", "config": "A4.yaml", "toc_mode": "simple", "volume_mode": "collection", "sample_pages": 50, "section": "", "out_name": "",
    "use_openai": False, "openai_qa": False, "ai_provider": "openai", "keep_all_images": False, "remove_all_images": False, "strict": False, "debug_html": True,
}
IMAGES = (".png", ".jpg", ".jpeg", ".webp")


def safe_name(name: Column, default: str) -> Column:
    """A file's own name with nothing but letters, digits, underscores, dots and hyphens."""
    last = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(last, r"(?U)[^\w.\-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit(default))


def upload_name(name: Column) -> Column:
    safe = safe_name(name, "book.epub")
    return F.when(F.endswith(F.lower(safe), F.lit(".epub")), safe).otherwise(F.concat(safe, F.lit(".epub")))


def out_name(wanted: Column, epub: Column) -> Column:
    """The PDF's name: the one asked for, else the book's, without its ending."""
    raw = F.element_at(F.split(F.coalesce(F.nullif(wanted, F.lit("")), epub), "/"), -1)
    return F.concat(safe_name(F.regexp_replace(raw, r"(?<=.)\.[^.]*$", ""), "print_ready"), F.lit(".pdf"))


def options(form: dict[str, Any]) -> dict[str, Any]:
    """A request's fields as options, trimmed, typed, with defaults for what is missing or blank."""
    out: dict[str, Any] = {}
    for name, default in FORM.items():
        value = form.get(name, default)
        if isinstance(default, bool):
            out[name] = value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(default, int):
            out[name] = max(0, int(value or 0))
        else:
            out[name] = str(value).strip() or (default if name in ("config", "toc_mode", "ai_provider") else "auto" if name == "volume_mode" else "")
    return out


def listing(made: DataFrame, log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs with their progress, stage, last lines and outcome, the newest first by ``place``."""
    from pyspark.sql.window import Window as W

    rows = made.join(jobs.state(log), "job_id", "left").join(jobs.tail(log), "job_id", "left").join(outcomes, "job_id", "left")
    status = F.coalesce("status", F.when(F.col("lines") > 0, "running").otherwise("queued"))
    rows = rows.withColumn("status", status).withColumn("progress", F.coalesce("progress", F.lit(0.0))).withColumn("lines", F.coalesce("lines", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("created"), "job_id")))


class Jobs:
    """The registry under ``root``, with config files in ``project``."""

    def __init__(self, spark: SparkSession, root: str, project: str = "."):
        self.spark, self.root, self.project = spark, root.rstrip("/"), project
        for name, schema in (("jobs", JOB), ("log", LINE), ("outcomes", OUTCOME)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{name}")

    def _add(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _one(self, column: Column) -> str:
        return self.spark.range(1).select(column).first()[0]

    def _fs(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save_upload(self, name: str, data: bytes) -> str:
        """Writes an uploaded book under a name of its own and returns its path."""
        if not data:
            raise ValueError("an empty upload")
        path = f"{self.root}/uploads/{uuid.uuid4().hex[:8]}_{self._one(upload_name(F.lit(PurePosixPath(name).name)))}"
        there, fs = self._fs(path)
        stream = fs.create(there, False)
        stream.write(data)
        stream.close()
        return path

    def create(self, epub: str, form: dict[str, Any]) -> dict[str, Any]:
        said = options(form)
        job = uuid.uuid4().hex[:12]
        self._add("jobs", JOB, [(job, epub, self._one(out_name(F.lit(said["out_name"]), F.lit(epub))), said["title"], json.dumps(said, sort_keys=True), time.time())])
        return self.get(job)

    def append(self, job: str, lines: list[str]) -> None:
        """Log lines in order; blank ones tell nothing and are left out."""
        now = time.time_ns()
        if rows := [(job, now + k, x.rstrip()) for k, x in enumerate(lines) if x.strip()]:
            self._add("log", LINE, rows)

    def finish(self, job: str, status: str, pdf: str = "", artifacts: str = "", error: str = "") -> None:
        self._add("outcomes", OUTCOME, [(job, status, pdf, artifacts, error, time.time())])

    def run(self, job: str, build: Callable[[dict[str, Any], Callable[[str], None]], tuple[str, str]]) -> dict[str, Any]:
        """Runs a build, which logs by its second argument and returns its PDF and artifacts; it fails if it raises or its PDF isn't there."""
        row = self.get(job)
        if not row:
            raise KeyError(job)
        try:
            pdf, artifacts = build(row, lambda line: self.append(job, [line]))
            there, fs = self._fs(pdf)
            done = fs.exists(there)
            self.finish(job, "done" if done else "failed", pdf, artifacts, "" if done else "no output was written")
        except Exception as e:  # noqa: BLE001 - a build may raise anything; the job tells
            self.finish(job, "failed", error=str(e))
        return self.get(job)

    def listing(self) -> DataFrame:
        return listing(self._read("jobs", JOB), self._read("log", LINE), self._read("outcomes", OUTCOME))

    def list(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.listing().orderBy("place").collect()]

    def get(self, job: str) -> dict[str, Any] | None:
        """One job, with what there is of its outputs."""
        rows = self.listing().where(F.col("job_id") == job).collect()
        if not rows:
            return None
        out = rows[0].asDict()
        has = lambda path: bool(path) and (lambda p: p[1].exists(p[0]))(self._fs(path))
        folder = out["artifacts"]
        out |= {"qa_images": self.qa_images(folder), "has_pdf": has(out["pdf"]), "has_qa_report": has(folder and f"{folder}/qa_report.txt"), "has_build_summary": has(folder and f"{folder}/build_summary.json"), "effective_settings": {}}
        if out["has_build_summary"]:
            try:
                out["effective_settings"] = json.loads("\n".join(r.value for r in self.spark.read.text(f"{folder}/build_summary.json").collect())).get("settings") or {}
            except (ValueError, AttributeError):
                pass
        return out

    def _names(self, pattern: str) -> list[str]:
        there, fs = self._fs(pattern)
        return sorted(str(x.getPath().getName()) for x in fs.globStatus(there) or ())

    def qa_images(self, artifacts: str | None) -> list[str]:
        """Images of sampled pages, then of reviewed ones, each in order of name."""
        return [n for kind in ("page", "review") for n in self._names(f"{artifacts}/qa/{kind}_*.png")] if artifacts else []

    def configs(self) -> list[dict[str, str]]:
        return [{"name": n, "path": n} for n in self._names(f"{self.project}/*.yaml") if not n.startswith(".")]

    def config_path(self, name: str) -> str:
        """A config inside of the project; raises for one outside of it or not there."""
        root = Path(self.project).resolve()
        path = (root / (name.strip() or "A4.yaml")).resolve()
        if path != root and root not in path.parents:
            raise PermissionError("configs must lie in the project's folder")
        if not path.exists():
            raise FileNotFoundError(name)
        return str(path)

    def file(self, job: str, kind: str, name: str = "") -> str:
        """The path of a job's output: pdf, report, or one of its images."""
        row = self.get(job)
        path = "" if not row else row["pdf"] if kind == "pdf" and row["has_pdf"] else f"{row['artifacts']}/qa_report.txt" if kind == "report" and row["has_qa_report"] else ""
        if row and kind == "image" and name in row["qa_images"] and name.lower().endswith(IMAGES):
            path = f"{row['artifacts']}/qa/{name}"
        if not path:
            raise FileNotFoundError(f"{job} {kind} {name}".strip())
        return path


def respond(registry: Jobs, method: str, path: str, form: dict[str, Any] | None = None, upload: tuple[str, bytes] | None = None) -> tuple[int, Any]:
    """(status, body) of a request; a body is a record, or the path of a file to send."""
    try:
        if method == "POST" and path == "/api/jobs":
            if not upload or not upload[0]:
                return 400, {"detail": "a book is needed"}
            return 200, registry.create(registry.save_upload(*upload), form or {})
        if path == "/api/health":
            return 200, {"status": "ok"}
        if path == "/api/configs":
            return 200, {"configs": registry.configs()}
        if path == "/api/jobs":
            return 200, {"jobs": registry.list()}
        if m := re.fullmatch(r"/api/jobs/([0-9a-f]+)", path):
            row = registry.get(m[1])
            return (200, row) if row else (404, {"detail": "no such job"})
        if m := re.fullmatch(r"/api/jobs/([0-9a-f]+)/(pdf|report|image)(?:/([^/]+))?", path):
            return 200, registry.file(m[1], m[2], m[3] or "")
    except (PermissionError, ValueError) as e:
        return 400, {"detail": str(e)}
    except FileNotFoundError as e:
        return 404, {"detail": str(e)}
    return 404, {"detail": "no such page"}


def catalogue(settings: DataFrame, folder: str) -> DataFrame:
    """Effective settings (name, value, layer, overridden) as the settings page shows them, blank values as ''."""
    return settings.select("name", clean_text(F.coalesce("value", F.lit(""))).alias("value"), "layer", coerce_bool(F.col("value")).alias("as_bool"), F.lit(folder).alias("config"))
