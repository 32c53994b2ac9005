"""Names and ids: where the answer depends on names given before."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.text import display_title, slugify


def batch_names(files: DataFrame, path: str = "path", stem: str = "stem") -> DataFrame:
    """Adds output: the stem's slug, with -n for the n-th file of one slug in the order of paths."""
    n = F.row_number().over(W.partitionBy("slug").orderBy(F.lower(path), path))
    rows = files.withColumn("slug", slugify(F.col(stem), "book")).withColumn("n", n)
    return rows.withColumn("output", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit("")), F.lit(".pdf"))).drop("n", "slug")


def _plain_slug(text: str) -> str:
    s = " ".join((text or "").split()).lower().replace("'", "")
    return re.sub(r"[^a-z0-9]+", "-", s).strip("-") or "section"


def take_id(base: str, used: set[str]) -> str:
    """The base's slug, or the first of slug-2, slug-3 … that is free; marks it as used."""
    slug = out = _plain_slug(base)
    n = 1
    while out in used:
        n += 1
        out = f"{slug}-{n}"
    used.add(out)
    return out


def unique_ids(titles: DataFrame) -> DataFrame:
    """Titles (book, seq, title) -> also ident, unique in its book.

    An ordered fold: whether x-2 is free depends on whether a title was called so. One
    book's titles go through one task; books are spread.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        pdf = pdf.sort_values("seq", kind="stable")
        return pdf.assign(ident=[take_id(t, used) for t in pdf["title"]])

    kept = titles.select("book", "seq", "title")
    return kept.groupBy("book").applyInPandas(fold, "book long, seq long, title string, ident string")


def title_and_source(metadata, fallback) -> list:
    """[title, provenance]: the metadata's title if it has one, else the file's, else Untitled."""
    own, other = F.nullif(display_title(metadata), F.lit("")), F.nullif(display_title(fallback), F.lit(""))
    return [F.coalesce(own, other, F.lit("Untitled")).alias("title"), F.when(own.isNotNull(), "EPUB metadata").otherwise("EPUB filename").alias("title_source")]


def kept_top_level(titles: Iterator[tuple[str, bool, bool]]) -> list[str]:
    """Titles (title, is division, is authored subwork) that stay at the top level: after a kept division, authored subworks wait for another kept title."""
    out, in_division = [], False
    for title, division, authored in titles:
        if not (in_division and authored):
            out.append(title)
            in_division = division
    return list(dict.fromkeys(out))
