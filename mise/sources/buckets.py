"""Keyed tables in hash buckets (R4, M1): a batch rewrites the buckets of its keys and no others.

A table is a folder of ``bucket=<n>/version=<batch>`` folders. ``apply_batch`` merges a batch's
changes into the newest earlier version of the buckets that its keys fall into and writes those as
version ``batch_id``, with dynamic partition overwrite; the other buckets are neither read
nor written. ``replace`` writes buckets whose rows the caller gives. A written version holds one row
that is not ``kept`` besides its rows, so that a bucket that became empty has a version, too. ``read_keyed`` takes each bucket's newest version. A version is a function of
earlier versions and the batch, so a batch replayed after a failure writes the same rows over its
own half-written ones and never reads them. ``expire`` deletes versions that no replay can
need: those older than the newest one at or before the oldest batch that may be replayed.

Which versions a bucket has is read from the folder names, bounded by buckets x kept versions.
All rows of a key are in one bucket (a hash of the key, or ``bucket_by``, a function of the key
columns like a month); keys are unique in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mise.operators.mutations import upsert

BUCKET, VERSION, KEPT = "bucket", "version", "kept"


class KeyedTable:
    """``schema``: the table's columns; ``keys``: its key; ``order``: the column that says which of
    several changes of a key in one batch is the last (it need not be a column of the table)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str],
                 order: str | None = None, buckets: int = 64, bucket_by: Column | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.keys, self.order, self.buckets, self.bucket_by = list(keys), order, buckets, bucket_by

    # ---- folders
    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self) -> dict[int, list[int]]:
        """Bucket -> its finished versions, oldest first."""
        fs, root = self._fs()
        out: dict[int, list[int]] = {}
        if not fs.exists(root):
            return out
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}=*/{VERSION}=*"))
        for status in found or []:
            p = status.getPath()
            out.setdefault(int(p.getParent().getName().split("=")[1]), []).append(int(p.getName().split("=")[1]))
        return {b: sorted(v) for b, v in out.items()}

    def _read(self, chosen: dict[int, int]) -> DataFrame:
        """The rows of the given version of each bucket; only those folders are listed."""
        full = T.StructType([*self.schema.fields, T.StructField(KEPT, T.BooleanType()),
                             T.StructField(BUCKET, T.IntegerType()), T.StructField(VERSION, T.LongType())])
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/{BUCKET}={b}/{VERSION}={v}" for b, v in sorted(chosen.items())]
        rows = self.spark.read.schema(full).option("basePath", self.path).parquet(*paths)
        return rows.filter(KEPT).select(*self.schema.names)

    def bucket(self) -> Column:
        if self.bucket_by is not None:
            return self.bucket_by.cast("int")
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # ---- reading and writing
    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The newest version of every bucket, or of those in ``only`` (of batches before ``before``)."""
        newest = {b: max(v) for b, vs in self.versions().items() if (only is None or b in only)
                  and (v := [x for x in vs if before is None or x < before])}
        return self._read(newest)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the rows' keys fall into: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias(BUCKET)).distinct().collect())

    def replace(self, rows: DataFrame, buckets: list[int], batch_id: int) -> None:
        """``rows`` become the content of ``buckets`` (all their keys must be of these)."""
        if not buckets:
            return
        marks = self.spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int").select(
            *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(False).alias(KEPT), BUCKET)
        full = rows.select(*self.schema.names).withColumn(KEPT, F.lit(True)).withColumn(BUCKET, self.bucket())
        # a bucket is one file unless it is large: AQE splits what the rebalance finds skewed
        (full.unionByName(marks).withColumn(VERSION, F.lit(batch_id).cast("bigint")).hint("rebalance", F.col(BUCKET))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(self.path))

    def apply_batch(self, changes: DataFrame, batch_id: int) -> list[int]:
        """Merge one batch (M1); returns the buckets written. Of several changes of a key the one
        with the largest ``order`` wins."""
        changes = changes.persist()
        try:
            touched = self.touched(changes)
            self.replace(upsert(self.read(batch_id, touched), changes, self.keys, self.order), touched, batch_id)
            return touched
        finally:
            changes.unpersist()

    def expire(self, oldest_replay: int) -> int:
        """Delete versions that a replay of batch ``oldest_replay`` or a later one cannot read;
        returns their number."""
        fs, _ = self._fs()
        gone = 0
        for b, vs in self.versions().items():
            needed = [v for v in vs if v < oldest_replay]
            for v in needed[:-1]:
                gone += bool(fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}/{VERSION}={v}"), True))
        return gone

    def sink(self, keep: int = 2):
        """A ``foreachBatch`` writer: merges each micro-batch, then forgets versions older than the
        last ``keep`` batches could need."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.apply_batch(batch, batch_id)
            self.expire(batch_id - keep + 1)
        return write
