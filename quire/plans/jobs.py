"""Jobs and batches: the state of each from its log, and reports over many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a progress line, "[3/12] what is done...".
PROGRESS = r"\[\s*([0-9]+)\s*/\s*([0-9]+)\]\s*(.+?)(?:\.\.\.|…|$)"
TAIL = 80


def parse(line: Column) -> list[Column]:
    """progress and stage that a log line tells; nulls where it tells neither."""
    done = F.contains(line, F.lit("Wrote PDF:"))
    n, of = F.regexp_extract(line, PROGRESS, 1).try_cast("double"), F.regexp_extract(line, PROGRESS, 2).try_cast("double")
    stage = F.regexp_replace(F.regexp_extract(line, PROGRESS, 3), r"^[ .]+|[ .]+$", "")
    hit = F.rlike(line, F.lit(PROGRESS))
    fix = F.startswith(line, F.lit("Auto-fix"))
    return [
        F.when(hit, F.least(F.lit(0.95), n / F.greatest(F.lit(1.0), of))).when(done, 1.0).alias("progress"),
        F.when(hit, stage).when(done, "Complete").when(fix, F.substring(line, 1, 120)).alias("stage"),
    ]


def state(log: DataFrame) -> DataFrame:
    """Log (job_id, seq, line) -> (job_id, progress, stage, lines): the last that was told of each; a second pass may go back."""
    rows = log.where(F.trim("line") != "").select("job_id", "seq", *parse(F.col("line")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("job_id").agg(F.coalesce(last("progress"), F.lit(0.0)).alias("progress"), last("stage").alias("stage"), F.count("*").alias("lines"))


def tail(log: DataFrame, n: int = TAIL) -> DataFrame:
    """(job_id, tail): each job's last lines. Lists are cut while they are made, so a long log costs no more."""
    from pyspark.sql.window import Window as W

    rows = log.where(F.trim("line") != "").withColumn("back", F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("seq")))).where(F.col("back") <= n)
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("tail"))


def batch_report(books: DataFrame) -> DataFrame:
    """(status) per book -> one row: total, succeeded, skipped, failed."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return books.agg(F.count("*").alias("total"), count("succeeded"), count("skipped"), count("failed"))
