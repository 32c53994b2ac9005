"""Named stages over tables: order, caching by content, and progress."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class PlanError(ValueError):
    pass


@dataclass
class Stage:
    name: str
    run: Callable[[dict[str, Any]], dict[str, Any]]
    after: tuple[str, ...] = ()
    key: Callable[[dict[str, Any]], str | None] | None = None


#: What a stage can be, and the version marks in its key.
STATUSES = ("pending", "cached", "running", "completed", "failed")
SCAN_VERSION, CLEAN_VERSION = "classification-v4-source-illustrations-frontmatter", "v18-skip-empty-body-shells"


@dataclass
class Plan:
    """Stages that read and add to one dict of outputs; ``status`` tells how far each has come."""

    stages: dict[str, Stage] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)

    def add(self, stage: Stage) -> Plan:
        if stage.name in self.stages:
            raise PlanError(f"stage {stage.name} is there twice")
        self.stages[stage.name] = stage
        return self

    def order(self) -> list[str]:
        """Names so that each comes after those it needs; of those that may go, the one added first."""
        place = {n: k for k, n in enumerate(self.stages)}
        if missing := sorted({d for s in self.stages.values() for d in s.after if d not in self.stages}):
            raise PlanError(f"no such stage: {', '.join(missing)}")
        sorter = TopologicalSorter({n: s.after for n, s in self.stages.items()})
        try:
            sorter.prepare()
        except CycleError as e:
            raise PlanError(f"stages wait for each other: {e.args[1]}") from e
        out: list[str] = []
        ready: list[str] = []
        while sorter.is_active():
            ready = sorted([*ready, *sorter.get_ready()], key=place.__getitem__)
            out.append(ready.pop(0))
            sorter.done(out[-1])
        return out

    def run(self, outputs: dict[str, Any] | None = None, cache: TableCache | None = None, say: Callable[[str], None] = lambda _: None) -> dict[str, Any]:
        """Runs all stages in order. A stage with a key and a stored DataFrame for it is read instead."""
        outputs = {} if outputs is None else outputs
        names = self.order()
        self.status = dict.fromkeys(names, "pending")
        for n, name in enumerate(names, 1):
            stage = self.stages[name]
            key = stage.key(outputs) if stage.key and cache else None
            say(f"[{n}/{len(names)}] {name}...")
            if key and cache.has(name, key):
                outputs[name] = cache.load(name, key)
                self.status[name] = "cached"
                continue
            self.status[name] = "running"
            try:
                outputs |= stage.run(outputs) or {}
                self.status[name] = "completed"
            except Exception as e:
                self.status[name] = "failed"
                raise PlanError(f"stage {name} failed: {e}") from e
            if key and isinstance(outputs.get(name), DataFrame):
                outputs[name] = cache.store(name, key, outputs[name])
        return outputs


@dataclass
class TableCache:
    """Tables by namespace and content hash, under a folder any Spark file system reaches."""

    spark: SparkSession
    root: str

    def path(self, namespace: str, key: str) -> str:
        return f"{self.root}/{namespace}/{key[:2]}/{key}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, namespace: str, key: str) -> bool:
        p, fs = self._fs(self.path(namespace, key) + "/_SUCCESS")
        return fs.exists(p)

    def store(self, namespace: str, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(namespace, key))
        return self.load(namespace, key)

    def load(self, namespace: str, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(namespace, key))

    def _write(self, path: str, data: bytes) -> None:
        p, fs = self._fs(path)
        stream = fs.create(p, True)
        stream.write(data)
        stream.close()

    def has_text(self, namespace: str, key: str) -> bool:
        p, fs = self._fs(self.path(namespace, key) + ".txt")
        return fs.exists(p)

    def store_text(self, namespace: str, key: str, text: str) -> None:
        self._write(self.path(namespace, key) + ".txt", text.encode())

    def load_text(self, namespace: str, key: str) -> str | None:
        """The stored text; nothing if there is none."""
        if not self.has_text(namespace, key):
            return None
        return bytes(self.spark.read.format("binaryFile").load(self.path(namespace, key) + ".txt").first().content).decode()

    def store_json(self, namespace: str, key: str, value: Any) -> None:
        self.store_text(namespace, key, json.dumps(value, sort_keys=True, ensure_ascii=False))

    def load_json(self, namespace: str, key: str) -> Any:
        """The stored value; nothing if there is none or it cannot be read."""
        text = self.load_text(namespace, key)
        try:
            return json.loads(text) if text is not None else None
        except ValueError:
            return None

    def invalidate_all(self) -> None:
        p, fs = self._fs(self.root)
        fs.delete(p, True)

    def invalidate(self, namespace: str, key: str | None = None) -> None:
        p, fs = self._fs(self.path(namespace, key) if key else f"{self.root}/{namespace}")
        fs.delete(p, True)


def hash_text(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def hash_object(value: Any) -> str:
    return hash_text(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str))


def content_hash(docs: DataFrame, book: str, order: str, content: str) -> DataFrame:
    """(book, hash): SHA-256 over the hashes of a book's documents in order; whole contents, not prefixes."""
    one = F.struct(F.col(order).alias("o"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("h"))
    return docs.groupBy(book).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["h"]), "|"), 256).alias("hash"))


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash): SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("hash"))


def _text(c: Column) -> Column:
    return F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)


def _joined(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def stage_keys(file: Column, option: Callable[[str], Column]) -> dict[str, Column]:
    """A stage's cache key from the book's hash and the options that the stage depends on.

    A key chains the key of the stage that feeds it, so a change anywhere before makes a
    new one. The plan of a reviewer has a key only where one is asked.
    """
    title = _joined(file, _text(option("title")))
    assets = _joined(file, _text(option("book_title")))
    scan = _joined(file, _text(option("rule_packs")), _text(F.lit(SCAN_VERSION)))
    review = F.when(option("use_openai").cast("boolean"), _joined(scan, *(_text(option(n)) for n in ("ai_provider", "openai_model", "deepseek_model", "book_title"))))
    fonts = _joined(*(_text(option(n)) for n in ("embed_font_files", "font_dir", "embedded_font_regular", "embedded_font_italic")))
    clean = _joined(scan, F.coalesce(review, F.lit("")), *(_text(option(n)) for n in ("image_policy", "smart_punctuation", "footnote_handling", "rule_packs", "title", "major_opener_blank_before", "major_opener_blank_after")), _text(F.lit(CLEAN_VERSION)))
    compose = _joined(clean, fonts, _text(option("settings")))
    check = _joined(compose, _text(option("runner_font_pt")), _text(option("runner_body_clearance_mm")))
    return {"resolve_title": title, "read_assets": assets, "scan_classify": scan, "ai_plan": review, "prepare_fonts": fonts, "clean_documents": clean, "compose_render": compose, "qa": check}
