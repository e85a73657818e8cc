"""Shared helpers: shipping the package to workers, shared folders, file access, columns."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    The zip is a few dozen KB of sources that the driver serves to its executors, so a
    cluster needs no installed copy.
    """
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.write(os.path.join(ROOT, "mise", "__init__.py"), "mise/__init__.py")
        folder = os.path.join(ROOT, "mise", "llm")
        for name in sorted(os.listdir(folder)):
            if name.endswith(".py"):
                z.write(os.path.join(folder, name), f"mise/llm/{name}")
    path = os.path.join(tempfile.mkdtemp(prefix="llm-src-"), "mise_llm.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._llm_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``, as a URI.

    Only a single-machine session without that setting (tests) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = "file://" + os.path.abspath(base.removeprefix("file:"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives
    lost executors, and gives the planner the true size of the table."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """A side of a join by shuffle. The planner would broadcast a table by its size as written, which
    can be a hundredth of its rows in memory (repeated values, rows still to be exploded): the driver
    builds what it sends."""
    return df.hint("merge")


def filesystem(uri: str):
    """(file system, path) of a URI inside a task; ``file``, ``hdfs``, ``s3`` and the like."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: what data is dealt over."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Exactly (doc_id long, text string), the text of a null being empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ascii_lower(col: F.Column) -> F.Column:
    """A-Z to a-z and nothing else. A text of single-byte characters takes the fast path."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
