r"""Line de-duplication with levelled sorted runs of line hashes (DataFrame functions only).

``LineRuns`` holds, on shared storage, how many documents each line key was found in:
tables of (128-bit key hash, documents), each sorted by hash. A batch of documents is
counted, merge-anti-joined with the keys that the runs have already settled (found in
``min_docs`` documents, so that more counting changes nothing), and added as a run of level
0. Whenever a level holds ``fanout`` runs they are merged, counts summed, into one run of the
next level, so that n batches leave O(log n) runs and each row is rewritten O(log n) times.

``drop_common_lines`` feeds a table through in batches and then drops the lines whose key was
found in at least ``min_docs`` documents of the whole table.

A key is a line with ``[\x20\x09-\x0D]`` stripped at both ends and A-Z lower-cased. Only
hashes, counts and positions are exchanged until the last join, which brings each
document's dropped positions to its text.

Cases: a null or empty text is one empty line; a line without any key character is never
dropped; a key repeated inside a document counts once for it; repeated rows are separate
documents; null ids and extra columns of any name are kept untouched; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mise.llm.common import ascii_lower, stored

STRIPPED = " \t\n\x0b\x0c\r"
MIN_DOCS = 10
BATCHES = 4
FANOUT = 3
KEY = ["h1", "h2"]


def line_key(line: F.Column) -> F.Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def hashes(*cols: F.Column) -> list[F.Column]:
    """A 128-bit hash as two columns."""
    return [F.xxhash64(F.lit(k), *cols).alias(name) for k, name in enumerate(KEY)]


class LineRuns:
    """Levelled sorted runs of (h1, h2, n): key hash and documents counted so far."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, counts: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run = stored(counts.sortWithinPartitions(*KEY), f"line-run-{level}")
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level]).groupBy(*KEY).agg(F.sum("n").alias("n"))
            self.levels[level] = []
            self._write(merged, level + 1)

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (h1, h2, n), one row per key."""
        for run in self.runs():
            settled = run.filter(F.col("n") >= self.min_docs).select(*KEY)
            counts = counts.join(settled, KEY, "left_anti")
        self._write(counts, 0)

    def common(self) -> DataFrame:
        """Hashes of the keys found in at least ``min_docs`` documents."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return reduce(DataFrame.unionByName, self.runs()).groupBy(*KEY).agg(F.sum("n").alias("n")).filter(
            F.col("n") >= self.min_docs).select(*KEY)


def as_rows(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs as they are, text: never null, d1 and d2: hash of id and text)."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    doc = F.col("row.doc_id").cast("string")
    key = [F.xxhash64(F.lit(k), doc.isNull(), doc, text).alias(f"d{k}") for k in (1, 2)]
    return docs.select(F.struct("*").alias("row")).select("row", text.alias("text"), *key)


def batch_counts(rows: DataFrame, batches: int) -> DataFrame:
    """(batch, h1, h2, n): documents of each batch that hold a key; keys of a document once."""
    keys = F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))
    lines = rows.select(F.pmod("d1", F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key"))
    return lines.filter(F.col("key") != "").select("batch", *hashes(F.col("key"))).groupBy(
        "batch", *KEY).agg(F.count("*").alias("n"))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                      fanout: int = FANOUT) -> DataFrame:
    """(row: the columns of docs, kept: text without its common lines, n_lines, n_dropped)."""
    rows = as_rows(docs)
    arriving = stored(batch_counts(rows, batches), "line-batches")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for k in range(batches):
        runs.add(arriving.filter(F.col("batch") == k).select(*KEY, "n"))
    common = stored(runs.common(), "common-lines")

    places = rows.select("d1", "d2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select(
        "d1", "d2", "at", *hashes(line_key(F.col("line"))))
    dropped = stored(places.join(common, KEY, "left_semi").groupBy("d1", "d2").agg(
        F.collect_set("at").alias("gone")), "dropped-lines")

    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    joined = rows.join(dropped, ["d1", "d2"], "left").withColumn("lines", lines)
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def digests(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per document."""
    return drop_common_lines(docs, min_docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
