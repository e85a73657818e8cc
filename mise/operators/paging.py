"""T7 paging by rank selection: pages of a long ordered table without merging it.

``store_pages`` writes the table once, range-partitioned and sorted by the order columns; every
row keeps its range and its place in it, and one row per range says how many rows it holds.
``read_page`` finds from those counts which ranges a page lies in: a page of any number,
clamped to the last, reads the one or two ranges (more only where ranges are smaller than a page)
that hold it, and of those, by the stored place, the row groups that hold its rows.
``page_after`` is the keyset form for "next page": the rows behind a given one.

The order columns must order all rows (end them with a key); ``(name, False)`` sorts
descending. NULLs come first, in descending order last, as in ``orderBy``. A stored copy is a
snapshot: ``store_pages`` again after a change. An empty table has one empty page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Order = list  # of column names, or (column name, ascending)
RANGE, PLACE = "page_range", "page_place"


def _pairs(order: Order) -> list[tuple[str, bool]]:
    return [(c, True) if isinstance(c, str) else (c[0], c[1]) for c in order]


def _sorts(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in _pairs(order)]


def store_pages(df: DataFrame, order: Order, path: str, ranges: int | None = None) -> None:
    """Write ``df`` for ``read_page`` under ``path``: ``rows`` and ``ranges``."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the low 33 bits of the id are the row's number in its task, that is in its range
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    (df.repartitionByRange(ranges, *_sorts(order)).sortWithinPartitions(*_sorts(order))
     .select("*", F.spark_partition_id().alias(RANGE), place.alias(PLACE))
     .write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows"))
    rows = spark.read.schema(_schema(df.schema)).parquet(f"{path}/rows")
    rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _schema(of: T.StructType) -> T.StructType:
    return T.StructType([*of.fields, T.StructField(PLACE, T.LongType()), T.StructField(RANGE, T.IntegerType())])


def read_page(spark: SparkSession, path: str, schema: T.StructType, page_no: int, size: int = 10) -> DataFrame:
    """Page ``page_no`` (from 1, clamped) of a stored table with its from/to/total. The driver
    sees one count per range."""
    counts = sorted(spark.read.schema(f"{RANGE} int, n bigint").parquet(f"{path}/ranges").collect())
    total = sum(n for _, n in counts)
    page_no = min(max(page_no, 1), max(1, -(-total // size)))
    start, end, before, held = (page_no - 1) * size, min(page_no * size, total), 0, F.lit(False)
    found = []
    for part, n in counts:
        first, last = max(start - before, 0), min(end - before, n)
        if first < last:
            found.append(part)
            held = held | ((F.col(RANGE) == part) & (F.col(PLACE) >= first) & (F.col(PLACE) < last))
        before += n
    rows = spark.read.schema(_schema(schema)).parquet(f"{path}/rows").filter(F.col(RANGE).isin(found) & held)
    return rows.orderBy(RANGE, PLACE).drop(RANGE, PLACE).select(
        "*", F.lit(page_no).alias("page"), F.lit(start + 1).alias("from_row"),
        F.lit(min(start + size, total)).alias("to_row"), F.lit(total).cast("bigint").alias("total"))


def behind(order: Order, key: dict) -> Column:
    """Rows that come after the one with the values ``key`` of the order columns."""
    out = F.lit(False)
    for c, up in reversed(_pairs(order)):
        col, value = F.col(c), key[c]
        if value is None:
            beyond, same = (col.isNotNull() if up else F.lit(False)), col.isNull()
        else:
            beyond = col > F.lit(value) if up else (col < F.lit(value)) | col.isNull()
            same = col == F.lit(value)
        out = beyond | (same & out)
    return F.coalesce(out, F.lit(False))


def page_after(df: DataFrame, order: Order, key: dict | None, size: int = 10) -> DataFrame:
    """The ``size`` rows after ``key`` (the first rows without one): a filter and a top-k, so a
    task keeps ``size`` rows however far down the page is."""
    rows = df if key is None else df.filter(behind(order, key))
    lead, up = _pairs(order)[0]
    if key is not None and key[lead] is not None and up:
        rows = rows.filter(F.col(lead) >= F.lit(key[lead]))      # reaches the scan
    return rows.orderBy(*_sorts(order)).limit(size)
