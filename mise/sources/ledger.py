"""Load ledger (S2, S3, U4, S7, M2): which files were loaded, and in which order.

A folder of landed files is registered once per load: every file that the ledger does not know yet
(by path and modification time) gets a row (load number, modification time, path). Rows of
several files then have an order that does not hang on how Spark deals files to tasks: load
number, modification time, path, byte offset of the split, line in the split. ``in_load_order``
adds it as the struct column ``batch`` that the sheet parsers and "last wins" rules take.

The ledger is a small table of files, one folder per load; a load that failed is registered again
under its number with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "load bigint, modified timestamp, path string, length bigint"


def _landed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The folder's files; only their names, times and sizes are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(
        folder).select(F.col("modificationTime").alias("modified"), "path", "length")


def register(spark: SparkSession, ledger: str, folder: str, load: int, pattern: str = "*") -> DataFrame:
    """Write the rows of load ``load``: the files of ``folder`` that earlier loads have not seen.
    Returns the whole ledger up to it."""
    landed = _landed(spark, folder, pattern)
    before = read(spark, ledger, load)
    if before is not None:
        landed = landed.join(before.select("path", "modified"), ["path", "modified"], "left_anti")
    landed.select(F.lit(load).cast("bigint").alias("load"), "modified", "path", "length").write.mode("overwrite").parquet(
        f"{ledger}/of={load}")
    return read(spark, ledger, load + 1)


def read(spark: SparkSession, ledger: str, before: int | None = None) -> DataFrame | None:
    """The ledger (of loads before ``before``); None when nothing was loaded."""
    root = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    loads = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("of="))
    loads = [n for n in loads if before is None or n < before]
    return spark.read.schema(FILES).parquet(*(f"{ledger}/of={n}" for n in loads)) if loads else None


def in_load_order(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows read from the ledger's files (a frame straight from a file reader) with their ``batch``;
    rows of files that are not in the ledger go. A file registered twice counts as last loaded."""
    line = F.monotonically_increasing_id()
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                         line.alias("_line"))
    last = files.groupBy("path").agg(F.max(F.struct("load", "modified")).alias("_load"))
    # both sides name files by URI; the reader writes file:///x, the listing file:/x
    norm = lambda c: F.regexp_replace(c, "^file:/+", "/")
    j = placed.join(last.select(norm(F.col("path")).alias("_file"), "_load"), norm(F.col("_path")) == F.col("_file"))
    batch = F.struct(F.col("_load.load").alias("load"), F.col("_load.modified").alias("modified"), F.col("_file").alias("path"),
                     F.col("_block").alias("block"), F.col("_line").alias("line"))
    return j.select(*rows.columns, batch.alias("batch"))
