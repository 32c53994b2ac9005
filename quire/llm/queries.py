"""The queries op1 to op10 and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table

#: Query name -> (module, function of its table, name of the table).
_OPERATORS = {
    "op1_suffix_dedup": ("suffix_dedup", "digest", "documents"),
    "op2_exact_dedup": ("exact_dedup", "dedup", "documents"),
    "op3_near_dedup": ("near_dedup", "digest", "documents"),
    "op4_html_extract": ("html_extract", "extract", "pages"),
    "op5_mixing": ("mixing", "mix", "documents"),
    "op6_license_scan": ("licenses", "scan", "documents"),
    "op8_pii": ("pii", "digest", "documents"),
    "op9_topk": ("topk", "topk", "embeddings"),
    "op10_bpe": ("bpe", "digest", "documents"),
}


def _query(module: str, function: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = getattr(import_module(f"quire.llm.{module}"), function)(table(spark, sf_dir, name))
        return out.drop("rid")

    return run


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import toxicity

    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {name: _query(*spec) for name, spec in _OPERATORS.items()} | {"op7_toxicity": _toxicity}


def oracle_sql() -> dict[str, str]:
    from quire.llm import exact_dedup, mixing, topk

    return {"op2_exact_dedup": exact_dedup.SQL, "op5_mixing": mixing.SQL, "op9_topk": topk.SQL}
