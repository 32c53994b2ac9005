"""Decisions from outside (a reviewer or a model) as tables; nothing here calls a service."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BATCH, SAMPLE, HEADINGS = 24, 3500, 20
_DOCUMENTS = "struct<documents:array<struct<index:long,kind:string,remove_document:boolean,major_title:string,current_division:string,confidence:double,notes:string>>>"


def first_json(text: str | None) -> dict:
    """The answer's object: the whole text without a code fence, else the first object in it that can be read; {} if none."""
    s = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    try:
        whole = json.loads(s)
        if isinstance(whole, dict):
            return whole
    except ValueError:
        pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", s):
        try:
            found, _ = decoder.raw_decode(s, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {}


def requests(docs: DataFrame) -> DataFrame:
    """Documents (book, doc_index, heading, text, n_chars) -> (book, batch, request): 24 documents each, samples cut."""
    one = F.struct("doc_index", "heading", F.substring("text", 1, SAMPLE).alias("text_sample"), "n_chars")
    rows = docs.withColumn("batch", F.floor(F.col("doc_index") / BATCH))
    return rows.groupBy("book", "batch").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("request"))


def ask(rows: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """Requests -> (book, batch, answer) through any callable; a failing call answers ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b["request"]:
                try:
                    out.append(answer(r))
                except Exception:  # noqa: BLE001 - a call's failure is no decision, whatever it was
                    out.append("")
            yield b[["book", "batch"]].assign(answer=out)

    return rows.mapInPandas(run, "book long, batch long, answer string")


def read(answers: DataFrame) -> DataFrame:
    """(book, answer) -> decisions (book, doc_index, kind, remove, major_title, confidence)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["book"]].assign(body=[json.dumps(first_json(a)) for a in b["answer"]])

    rows = answers.select("book", "answer").mapInPandas(run, "book long, body string")
    d = rows.select("book", F.explode(F.from_json("body", _DOCUMENTS)["documents"]).alias("d")).where("d.index is not null")
    return d.select("book", F.col("d.index").alias("doc_index"), F.col("d.kind").alias("kind"), F.coalesce("d.remove_document", F.lit(False)).alias("remove"), F.col("d.major_title").alias("major_title"), F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"))


def review_text(pages: DataFrame, first: int = 50, extra: tuple[int, ...] = (), per_page: int = 3500, total: int = 60_000) -> DataFrame:
    """Pages (book, page, text) -> (book, text): the first and some extra pages, each cut, as many as fit the total."""
    rows = pages.where((F.col("page") <= first) | F.col("page").isin(*extra) if extra else F.col("page") <= first).withColumn("part", F.substring("text", 1, per_page))
    before = F.coalesce(F.sum(F.length("part")).over(W.partitionBy("book").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part", F.expr("part")).withColumn("room", F.lit(total) - before).where("room > 0")
    one = F.struct("page", F.expr("substring(part, 1, cast(room as int))").alias("t"))
    return rows.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("text"))
