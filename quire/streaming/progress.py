"""Job progress as a stream of log lines, and windowed counts of events.

The windowed counts and the watermark are extensions: the job log alone needs neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.jobs import parse


def job_states(log: DataFrame) -> DataFrame:
    """A stream (job_id, seq, line) -> update-mode table (job_id, progress, stage, lines), the last told of each."""
    rows = log.where(F.trim("line") != "").select("job_id", "seq", *parse(F.col("line")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("job_id").agg(last("progress").alias("progress"), last("stage").alias("stage"), F.count("*").alias("lines"))


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A stream (ts, event_type, value) -> (start, event_type, n, total) by tumbling windows; state older than ``late`` is dropped."""
    ts = F.col("ts").cast("timestamp")
    return (
        events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def start(out: DataFrame, name: str, checkpoint: str | None = None, mode: str = "update"):
    """Runs a stream into an in-memory table of that name; what is there now, then it waits."""
    writer = out.writeStream.outputMode(mode).format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
