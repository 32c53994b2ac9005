"""Builds books: python -m quire INPUT OUTPUT [--config FILE] [--toc-mode MODE] [--section TITLE] …

INPUT is a folder of EPUB files, or a Parquet table of pages (page_id, url, html). OUTPUT
gets books/ (one document each), style/ (the stylesheet), findings/ and summary.json.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.patterns import REGISTRY
from quire.operators import compose, quality, stylesheet
from quire.plans import build, settings
from quire.sources import epub, rules

PER_BOOK = 100_000


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--config", help="settings as YAML or JSON")
    p.add_argument("--rule-packs", help="names of rule packs, separated by commas")
    p.add_argument("--per-book", type=int, default=10, help="pages of a book, for tables of pages")
    p.add_argument("--strict", action="store_true", help="end with 1 if a blocking finding is there")
    for name, default in settings.DEFAULTS.items():
        flag = "--" + name.replace("_", "-")
        if flag in ("--rule-packs", "--strict"):
            continue
        if isinstance(default, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            p.add_argument(flag, type=type(default) if isinstance(default, (int, float)) else str, default=None)
    return p.parse_args(argv)


def pages_of(spark: SparkSession, source: str, per_book: int) -> tuple[DataFrame, int]:
    """Pages of EPUB files, a book per file in the order of paths; or the table as it is."""
    if source.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(source), per_book
    rows = epub.pages(epub.spine(spark, source))
    files = rows.select("path").distinct().withColumn("n", F.row_number().over(W.orderBy(F.lower("path"), "path")) - 1)  # a row per file
    return rows.join(files, "path").select((F.col("n") * PER_BOOK + F.col("page_id")).alias("page_id"), "url", "html"), PER_BOOK


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Builds, writes, checks; returns the summary."""
    values, unknown = settings.resolve(settings.read_config(args.config) if args.config else {}, {k: v for k, v in vars(args).items() if k in settings.DEFAULTS and k != "strict"})
    if args.rule_packs:
        rules.load(args.rule_packs, values["rule_pack_dir"], REGISTRY)
    pages, per_book = pages_of(spark, args.input, args.per_book)
    out = build.build(pages, per_book, values=values)
    compose.write(out["books"], f"{args.output}/books")
    lines = out["marked"].where("text <> ''").select("book", (F.col("doc_index") + 1).alias("page"), F.col("block_no").alias("line_no"), "text")
    findings = quality.line_spills(lines).unionByName(quality.image_names(lines)).unionByName(quality.source_apparatus(lines)).unionByName(quality.stranded_headings(lines))
    findings.write.mode("overwrite").parquet(f"{args.output}/findings")
    stored = spark.read.schema(findings.schema).parquet(f"{args.output}/findings")
    totals = quality.verdict(stored).agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.coalesce(F.sum("blockers"), F.lit(0)).alias("blockers")).first()
    summary = {"books": out["docs"].select("book").distinct().count(), "findings": totals.findings, "blockers": totals.blockers, "unknown_settings": unknown}
    spark.createDataFrame([(stylesheet.css(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/style")
    if "://" not in args.output:
        Path(args.output, "summary.json").write_text(json.dumps(summary, sort_keys=True), encoding="utf-8")
    return summary


def main(argv: Sequence[str] | None = None) -> int:
    args = parse(argv)
    summary = run(SparkSession.builder.appName("quire").getOrCreate(), args)
    print(json.dumps(summary, sort_keys=True))
    return int(args.strict and summary["blockers"] > 0)


if __name__ == "__main__":
    raise SystemExit(main())
