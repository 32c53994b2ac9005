"""What a reviewer's words mean for a build: flags by category, feedback text, and the audit of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category, the words that tell of it, the flag it raises.
CATEGORIES = (
    ("header", r"header|runner|running head|rule|collision|crowd", "OpenAI visual QA flagged possible running-head/header-rule issue."),
    ("body", r"justif|ragged|word spacing|river|paragraph|indent|line spill|single-letter|broken word|narrow|overwide", "OpenAI visual QA flagged possible body-typography/justification issue."),
    ("title", r"chapter|title|heading|opener|stranded", "OpenAI visual QA flagged possible chapter/title placement issue."),
    ("contents", r"TOC|contents|leader|duplicate|page number", "OpenAI visual QA flagged possible TOC/page-number issue."),
    ("folio", r"folio|page number|roman|arabic|numbering", "OpenAI visual QA flagged possible folio/page-numbering issue."),
    ("image", r"image|caption|portrait|plate|illustration|cropped|oversized", "OpenAI visual QA flagged possible image/caption cleanup issue."),
    ("verse", r"poetry|verse|drama|cast|stage direction|blockquote|letter", "OpenAI visual QA flagged possible poetry/drama/special-form issue."),
    ("blank", r"blank|empty|title-only|dark|black|artifact|raw ebook|blue|underlined|hyperlink|browser", "OpenAI visual QA flagged possible blank/artifact/raw-ebook issue."),
)


def categories(issues: Column) -> Column:
    """Names of the categories that a reviewer's text speaks of, in their order."""
    hits = F.array(*(F.when(F.rlike(F.coalesce(issues, F.lit("")), F.lit(f"(?i){words}")), name) for name, words, _ in CATEGORIES))
    return F.filter(hits, lambda x: x.isNotNull())


def flags(issues: Column) -> Column:
    """The flags that a reviewer's text raises."""
    hits = F.array(*(F.when(F.rlike(F.coalesce(issues, F.lit("")), F.lit(f"(?i){words}")), flag) for _, words, flag in CATEGORIES))
    return F.filter(hits, lambda x: x.isNotNull())


def add_flags(held: Column, new: Column) -> Column:
    """Flags with some more, each once, the held ones first."""
    return F.array_union(F.coalesce(held, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def feedback_text(*lists: Column) -> Column:
    """All flags and issue lines of a verdict, a line each."""
    return F.array_join(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))), "\n")


def speaks_of(pattern: str, *lists: Column) -> Column:
    return F.rlike(feedback_text(*lists), F.lit(f"(?i){pattern}"))


def note(audit: DataFrame, channel: str, messages: list[str]) -> DataFrame:
    """The audit (channel, message) with warnings, failures or removals of a run added."""
    spark = audit.sparkSession
    return audit.unionByName(spark.createDataFrame([(channel, m) for m in messages], "channel string, message string"))


def snapshot(audit: DataFrame) -> DataFrame:
    """(channel, n): how much each channel of an audit holds."""
    return audit.groupBy("channel").agg(F.count("*").alias("n"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(channel, n): what channels hold more after than before; those that grew."""
    rows = after.select("channel", F.col("n").alias("_a")).join(before.select("channel", F.col("n").alias("_b")), "channel", "left")
    return rows.select("channel", (F.col("_a") - F.coalesce("_b", F.lit(0))).alias("n")).where("n > 0")


def replay(counts: DataFrame, found: DataFrame) -> DataFrame:
    """Counts with those of a run that was read from the cache added."""
    return counts.unionByName(found.select(*counts.columns)).groupBy("channel").agg(F.sum("n").alias("n"))
