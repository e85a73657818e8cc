"""Sales facts stored for their join (J1): bucketed by sale id, partitioned by year.

``store_sales`` writes the headers and the lines as two catalog tables with the same number of
buckets on ``sale_id``; the lines carry their sale's year. A bucket of one table meets the same bucket of
the other in one task, so J1 joins without a shuffle, and a date filter prunes year folders of
both tables. The files lie under ``path`` in the shared folder. The lines are shuffled once, when
they are stored, not in every query. ``buckets`` is for the table's life, and a task of the join sorts and
sums a bucket of all the years read: the number follows from the lines (``ROWS`` a bucket) unless the
caller, who knows how the table will grow, names it.
A hot sale id is one bucket's matter: AQE cannot split a join without exchanges, so for such data
use J1 over the plain tables (``operators.sales.sold_lines``), which does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(df: DataFrame, table: str, path: str, buckets: int) -> None:
    # dealt by the bucket's own hash: one task writes a bucket, one file a year
    (df.repartition(buckets, "sale_id").sortWithinPartitions("year", "sale_id")
     .write.mode("overwrite").option("path", path).partitionBy("year").bucketBy(buckets, "sale_id").sortBy("sale_id")
     .saveAsTable(table))


ROWS, LEAST = 500_000, 8


def store_sales(sales: DataFrame, items: DataFrame, name: str, path: str, buckets: int | None = None) -> None:
    """Store ``sales`` (id, created_at, ...) as ``<name>_heads`` and ``items`` (sale_id, ...) as
    ``<name>_lines``. Lines without a header go to no year and no join; they are not stored."""
    if buckets is None:
        buckets = max(LEAST, -(-items.count() // ROWS))
    heads = sales.withColumnRenamed("id", "sale_id").withColumn("year", F.year("created_at"))
    _write(heads, f"{name}_heads", f"{path}/heads", buckets)
    years = heads.select("sale_id", "year")
    _write(items.join(years, "sale_id"), f"{name}_lines", f"{path}/lines", buckets)


def stored_lines(spark: SparkSession, name: str, since: str) -> DataFrame:
    """J1 over the stored tables: lines with their header's date, since a day."""
    year = int(since[:4])
    heads = spark.table(f"{name}_heads").filter((F.col("year") >= year) & (
        F.col("created_at") >= F.lit(since).cast("timestamp"))).select("sale_id", "created_at")
    lines = spark.table(f"{name}_lines").filter(F.col("year") >= year).drop("year")
    return lines.join(heads, "sale_id")


def stored_daily_units(spark: SparkSession, name: str, since: str) -> DataFrame:
    """A6 over the stored tables."""
    return stored_lines(spark, name, since).groupBy("dish_id", F.to_date("created_at").alias("dia")).agg(
        F.sum("quantity").cast("bigint").alias("unidades"))
