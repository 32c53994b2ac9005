"""Where outputs go, as expressions over tables of options, and the driver's own path checks."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.patterns import PACK_KEYS
from quire.functions.text import slugify


def output_pdf(out: Column, folder: Column) -> Column:
    """A bare file name goes under the output folder; a path stays."""
    return F.when(F.contains(out, F.lit("/")), out).otherwise(F.concat(folder, F.lit("/"), out))


def stem(path: Column) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def artifact_dir(root: Column, pdf: Column) -> Column:
    slug = slugify(stem(pdf))
    return F.concat(root, F.lit("/"), F.when(slug == "section", "run").otherwise(slug))


def toc_mode(mode: Column) -> Column:
    """simple or hierarchical as said, else simple."""
    said = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.when(said.isin("simple", "hierarchical"), said).otherwise("simple")


def project_path(text: str, root: str = ".") -> str:
    """A path as it is if absolute, else below the working folder if it is there, else below the project's root."""
    path = Path(text).expanduser()
    if path.is_absolute():
        return str(path)
    here = (Path.cwd() / path).resolve()
    return str(here if here.exists() else (Path(root) / path).resolve())


def batch_folder(output_dir: str, out: str | None = None, out_said: bool = False, folder_said: bool = False) -> str:
    """The folder of a batch: the one that was said, else an --out that isn't a PDF's name, else the default."""
    if out_said and not folder_said:
        if str(out).lower().endswith(".pdf"):
            raise ValueError("--out of a batch must be a folder, not a .pdf file")
        return str(Path(str(out)).expanduser().resolve())
    return str(Path(output_dir).expanduser().resolve())


def report_path(root: str, now: datetime | None = None) -> str:
    return f"{root}/batch_report_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}.json"


def writable(path: str) -> None:
    """Raises if an output is there and cannot be overwritten."""
    there = Path(path)
    there.parent.mkdir(parents=True, exist_ok=True)
    if there.exists():
        with there.open("r+b"):
            pass


def write_suggestions(path: str, found: dict[str, list[str]], source: str) -> None:
    """Suggested rules for a person to review, in the registry's order of keys."""
    lines = ["# Suggested rules. Check each against real books before loading this file.", f"# From: {Path(source).name}", ""]
    for key in PACK_KEYS:
        if found.get(key):
            lines += [f"{key}:", *(f"  - {json.dumps(v, ensure_ascii=False)}" for v in found[key]), ""]
    Path(path).write_text("\n".join(lines), encoding="utf-8")


def options_of(book: dict, name: str, folder: str, title: str | None) -> dict:
    """A batch's options as one book's."""
    return book | {"out": name, "output_dir": folder, "title": title, "batch": None}


def as_json(*columns: str) -> Column:
    """Any record as JSON, its names sorted."""
    return F.to_json(F.struct(*sorted(columns)))
