"""The stored tables as the engine's inputs: pages as spines, documents' lines as laid-out lines.

pages: ten neighbours are a book. documents: a document is a book, its lines are laid
out 26 to a page. conversations: a conversation is a book, a turn a document. events: a
user's events are a job's log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import clean_text
from quire.operators import spine

PER_PAGE = 26
#: Stages of a job's log by event type, as SQL both engines read.
LOG = "case event_type when 'click' then '[2/12] read assets...' when 'view' then '[ 3/12] scan and classify...' when 'purchase' then '[7/12] compose...' when 'add_to_cart' then '[9/12] post process...' when 'signup' then 'Auto-fix: line height' else 'Wrote PDF: out.pdf' end"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page, line_no, text) of every document's lines; blank lines are kept as ''."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return rows.select("book", (F.floor(F.col("pos") / PER_PAGE) + 1).cast("long").alias("page"), (F.col("pos") + 1).cast("long").alias("line_no"), clean_text(F.col("t")).alias("text"))


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a place: y, width and size that follow from the line's number and length."""
    rows = lines(spark, sf_dir)
    return rows.withColumn("y", (F.lit(50) + (F.col("line_no") - 1) % PER_PAGE * 28).cast("double")).withColumn("width", F.least(F.length("text") * 5, F.lit(450)).cast("double")).withColumn("size", F.when(F.length("text") < 12, 9.0).otherwise(11.6))


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.probe(read(spark, sf_dir, "pages"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: kinds and flags follow from a turn's words, titles from its start."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("book"), F.col("turn").alias("doc_index"), F.substring("text", 1, 24).alias("major_title"), F.substring("text", 1, 24).alias("heading"),
        F.expr("case length(text) % 6 when 0 then 'frontmatter' when 1 then 'major_work' when 2 then 'division' when 3 then 'backmatter' when 4 then 'promo' else 'chapter' end").alias("kind"),
        (F.length("text") % 6 == 4).alias("remove"), F.when(F.length("text") % 12 == 4, "gallery").alias("rule"), F.length("text").cast("long").alias("n_chars"),
        (F.length("text") % 3 - 1).cast("long").alias("n_headings"), (F.col("turn") % 2).cast("long").alias("images"), F.regexp_count("text", F.lit("[^ \n]+")).cast("long").alias("n_words"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(LOG).alias("line"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents entries of the books of pages: headings as titles, levels and kinds from the classifier."""
    rows = spine.classify(probed(spark, sf_dir)).where("heading <> ''")
    return rows.select("book", F.col("doc_index").alias("seq"), (F.col("doc_index") % 5).alias("level"), F.col("heading").alias("title"), F.concat(F.lit("p"), F.col("doc_index").cast("string")).alias("target_id"), F.when(F.col("kind") == "frontmatter", "frontmatter").otherwise("work").alias("kind"), (F.col("doc_index") % 2).alias("source_level"))


#: The same inputs as DuckDB subqueries.
DUCK_LINES = f"""(select doc_id as book, ((i - 1) // {PER_PAGE} + 1)::bigint as page, i::bigint as line_no, trim(regexp_replace(t, '\\s+', ' ', 'g')) as text
 from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"""
DUCK_LAID_OUT = f"(select *, (50 + (line_no - 1) % {PER_PAGE} * 28)::double as y, least(length(text) * 5, 450)::double as width, case when length(text) < 12 then 9.0 else 11.6 end::double as size from {DUCK_LINES})"
DUCK_TURNS = """(select conv_id as book, turn as doc_index, substr(text, 1, 24) as major_title, substr(text, 1, 24) as heading,
 case length(text) % 6 when 0 then 'frontmatter' when 1 then 'major_work' when 2 then 'division' when 3 then 'backmatter' when 4 then 'promo' else 'chapter' end as kind,
 length(text) % 6 = 4 as remove, case when length(text) % 12 = 4 then 'gallery' end as rule, length(text)::bigint as n_chars, (length(text) % 3 - 1)::bigint as n_headings, (turn % 2)::bigint as images,
 len(regexp_extract_all(text, '[^ \\n]+'))::bigint as n_words from conversations)"""
DUCK_LOG = f"(select user_id as job_id, event_id as seq, {LOG} as line from events)"
