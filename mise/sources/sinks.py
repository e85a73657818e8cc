"""Sinks (K1-K4): full refresh, idempotent daily snapshot, CSV export, run log.

Writes go to a shared table location; none of them collect rows to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mise.functions.expr import lenient_number

# The export header of the inventory CSV.
EXPORT_COLUMNS = ["Clasificacion", "Producto", "Marca", "Proveedor", "Presentacion", "Unidad",
                  "Cantidad", "Costo/Unidad", "Valor Total", "Observacion"]


def write_full(df: DataFrame, path: str) -> None:
    """K1: overwrite rows and schema. The new table is written beside the old one and takes its
    place when it is whole: a write that fails leaves the old table as it was."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (
        path.rstrip("/"), f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"))
    fs = target.getFileSystem(conf)
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)          # an earlier run ended between its two renames
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(new, target):
        raise RuntimeError(f"{new} could not take the place of {path}")
    fs.delete(old, True)


def replace_days(df: DataFrame, path: str, day_col: str = "fecha_scrape", days: list | None = None,
                 tasks: int | None = None) -> None:
    """K2: idempotent daily snapshot - the days present in ``df`` and those listed in ``days``
    are replaced, other days are kept. Re-running gives the same rows.

    A listed day without rows loses its earlier rows; one aggregate says which these are. A day's rows are dealt over ``tasks``
    tasks (default: the session's shuffle partitions) by a hash of the row, so that one large
    day is not one task; AQE joins small ones."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c != day_col]
    (df.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(tasks)))
     .hint("rebalance", F.col(day_col), F.col("_salt")).drop("_salt")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path))
    listed = df.filter(F.col(day_col).cast("string").isin([str(d) for d in days or []])).select(F.col(day_col).cast("string"))
    had_rows = {r[0] for r in listed.distinct().collect()} if days else set()
    for day in days or []:
        if str(day) not in had_rows:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day_col}={day}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def inventory_export_frame(ing: DataFrame) -> DataFrame:
    """K3: the 10 export columns; Valor Total = count x cost with non-numeric -> 0."""
    def txt(c):
        return F.coalesce(F.col(c), F.lit(""))
    total = lenient_number("count", "decimal(12,2)") * lenient_number("cost", "decimal(12,2)")
    return ing.select(
        txt("classification").alias("Clasificacion"), F.col("name").alias("Producto"),
        txt("brand").alias("Marca"), txt("supplier").alias("Proveedor"),
        txt("presentation").alias("Presentacion"), F.col("measure").alias("Unidad"),
        F.col("count").cast("double").alias("Cantidad"),
        F.col("cost").cast("double").alias("Costo/Unidad"),
        total.cast("double").alias("Valor Total"),
        (txt("notes") if "notes" in ing.columns else F.lit("")).alias("Observacion"))


def export_inventory(ing: DataFrame, path: str) -> None:
    """K3: write the export as CSV with a header (values quoted where needed)."""
    inventory_export_frame(ing).write.mode("overwrite").option("header", True).csv(path)


RUN_LOG_SCHEMA = T.StructType([
    T.StructField("sync_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("items_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
])


def log_runs(runs: DataFrame, path: str, error_when_empty: bool = False) -> None:
    """K4 for many runs at once: (sync_type, message, items_count, created_at) rows, one write."""
    status = F.when(F.lit(error_when_empty) & (F.col("items_count") == 0), "error").otherwise("success")
    runs.select("sync_type", status.alias("status"), "message", F.col("items_count").cast("int").alias("items_count"),
                F.col("created_at").cast("timestamp").alias("created_at")).write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, sync_type: str, items_count: int,
            message: str = "", at: _dt.datetime | None = None, error_when_empty: bool = False) -> None:
    """K4: append one run-log row; an order sync with 0 items is logged as 'error'."""
    row = [(sync_type, message, int(items_count), at or _dt.datetime.now(_dt.timezone.utc))]
    run = spark.createDataFrame(row, "sync_type string, message string, items_count int, created_at timestamp")
    log_runs(run, path, error_when_empty)


def latest_runs(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """K4: the newest ``n`` log rows."""
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path).orderBy(F.desc("created_at")).limit(n)
