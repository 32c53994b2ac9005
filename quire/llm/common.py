"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this package:

* only the columns an operator names are read, so extra or clashing columns of
  the input never reach a plan;
* a row is identified inside an operator by ``rid`` (see ``with_rid``), never by
  ``doc_id``, so null and repeated ids are ordinary values;
* a null text is the empty text.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the corpus contracts: a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a Parquet file: columns and filters over one scan, nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself where it is a scan of Parquet files, else its rows written once and read back."""
    return df if _is_scan(df) else materialise(df, "input")


#: Rows that a file may always have; files are told apart by hashes at least that far apart.
FILE_ROWS = 1 << 31


def _salt(files: list[str]) -> tuple[int, int]:
    """A salt that keeps the files' first ids far apart, and how far that is."""
    best = (0, 0)
    for salt in range(16):
        at = np.sort(np.array([xxhash.xxh64_intdigest(f"{f}#{salt}".encode(), 42) >> 2 for f in files], np.int64))
        gap = int(np.diff(at).min(initial=1 << 62))
        if gap > best[1]:
            best = (salt, gap)
        if gap >= FILE_ROWS:
            break
    return best


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """Adds a row id that belongs to the stored row: its file's hash plus its place in the file.

    It doesn't depend on how files are dealt to tasks, so every use of a table, in
    whatever plan and with however many cores or executors, sees the same ids. The
    files' hashes are checked to lie further apart than a file has rows; a file that
    is larger still fails the query. ``df`` must be stored().
    """
    files = [re.sub("^file:/+", "file:/", f) for f in df.inputFiles()]
    salt, gap = _salt(files)
    place = df.metadataColumn("_metadata")
    first = F.shiftrightunsigned(F.xxhash64(F.concat(place["file_path"], F.lit(f"#{salt}"))), 2)
    row = F.when(place["row_index"] < gap, place["row_index"]).otherwise(F.raise_error(F.lit("a file has too many rows for row ids")))
    return df.select("*", (first + row).alias(name))


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """(rid, doc_id as long, the named columns) of a table."""
    docs = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns))
    return with_rid(docs).select("rid", "doc_id", *columns)


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``most`` bytes of a text column each; a longer row is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else; a text of one-byte characters alone takes the fast way."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, ASCII_UPPER, ASCII_UPPER.lower()))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quire/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def clear(spark: SparkSession) -> None:
    """Deletes every table this application has written; no result of its operators can be read after that."""
    _delete(spark, _own_folder(spark))


#: Shuffle partitions of written tables after which the driver lets go of what is done.
TASKS = 500
_tasks = 0


def release(spark: SparkSession) -> None:
    """Frees what the driver holds for finished jobs.

    Spark gives up broadcasts, shuffles and plans only when the driver's JVM collects
    the objects that name them, and a JVM with room left grows its heap first.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def _release_now_and_then(spark: SparkSession) -> None:
    """release() in proportion to the tasks behind the tables that are written."""
    global _tasks
    _tasks += partitions(spark)
    if _tasks >= TASKS:
        _tasks = 0
        release(spark)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads them back."""
    spark = df.sparkSession
    _release_now_and_then(spark)
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def materialise_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """As materialise(), dealt to files by a hash of ``key``: grouping by it afterwards moves no rows."""
    spark = df.sparkSession
    _release_now_and_then(spark)
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{_own_folder(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the name alone; the files stay
    out.quire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "quire_path", None)
        if path:
            _delete(df.sparkSession, path)


class Scratch:
    """The tables an operator writes on its way; finish() leaves its result alone."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        out = materialise(df, label)
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        discard(*tables)
        self.tables = [t for t in self.tables if all(t is not x for x in tables)]

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as a table, without any of the others."""
        out = materialise(df, label)
        self.drop(*self.tables)
        return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` joined to ``groups``, a stored row per key whose column ``count`` is the key's number of rows.

    A group with more rows than a quarter of a task's even share is joined by
    broadcast, where its rows stay wherever they are; there are at most four such
    groups for each shuffle partition. All others are joined by shuffling.
    """
    found = groups.agg(F.sum(count).alias("n"), F.max(count).alias("most")).first()
    share = max(1, (found.n or 0) // (4 * partitions(rows.sparkSession)))
    if (found.most or 0) <= share:
        return rows.join(groups, on)
    hot = F.broadcast(groups.where(F.col(count) > share))
    rest = rows.join(F.broadcast(groups.where(F.col(count) > share).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(groups.where(F.col(count) <= share), on))
