"""Substring search by index (P11, P13, P14): which rows can hold a term, without a scan.

``build`` stores the rows, each with its part and place, and posting lists of the lower-cased
three-character pieces of every column: per (piece, part, block of ``BLOCK`` places) the sorted
places, as offsets from the block. A list therefore has at most ``BLOCK`` entries however common
a piece is, and no group grows with the table. A search reads the lists of the term's pieces only
(files sorted by piece), intersects them block by block, reads the parts that are left and verifies
each candidate row with the plain predicate. Terms of fewer than three characters have no piece
and are looked for by a scan, which the caller can see in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE, BLOCK = 3, 4096
PART, PLACE = "index_part", "index_place"


def _pieces(text: Column) -> Column:
    """The distinct pieces of a lower-cased text."""
    starts = F.sequence(F.lit(1), F.char_length(text) - (PIECE - 1))
    return F.when(F.char_length(text) >= PIECE, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, PIECE))))


def term_pieces(term: str) -> list[str]:
    t = term.lower()
    return sorted({t[k:k + PIECE] for k in range(len(t) - PIECE + 1)})


def _texts(columns: list[str]) -> list[Column]:
    return [F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns]


def build(df: DataFrame, path: str, columns: list[str] | None = None, parts: int | None = None) -> None:
    """Store ``df`` under ``path`` with an index of ``columns`` (all by default)."""
    spark = df.sparkSession
    columns = columns or df.columns
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    (df.repartition(parts).select("*", F.spark_partition_id().alias(PART), place.alias(PLACE))
     .write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows"))
    rows = _rows(spark, path, df.schema)
    pieces = rows.select(PART, PLACE, F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(
        *(_pieces(t) for t in _texts(columns))))))).alias("piece"))
    lists = pieces.groupBy("piece", PART, F.floor(F.col(PLACE) / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list((F.col(PLACE) % BLOCK).cast("short"))).alias("places"))
    lists.repartitionByRange(parts, "piece", PART, "block").sortWithinPartitions("piece", PART, "block").write.mode(
        "overwrite").parquet(f"{path}/lists")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.IntegerType())])
    return spark.read.schema(full).parquet(f"{path}/rows")


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(part, place) of the rows that hold every piece of the term: a superset of the matches."""
    pieces = term_pieces(term)
    lists = spark.read.schema(f"piece string, {PART} int, block bigint, places array<smallint>").parquet(f"{path}/lists")
    found = lists.filter(F.col("piece").isin(pieces)).groupBy(PART, "block").agg(F.collect_list("places").alias("p"))
    both = F.aggregate(F.slice("p", 2, len(pieces)), F.element_at("p", 1), F.array_intersect)
    return found.filter(F.size("p") == len(pieces)).select(PART, "block", F.explode(both).alias("at")).select(
        PART, (F.col("block") * BLOCK + F.col("at")).alias(PLACE))


def holds(columns: list[str], term: str) -> Column:
    """The plain predicate: some column's text holds the term, ignoring case."""
    return F.exists(F.array(*_texts(columns)), lambda x: x.contains(term.lower()))


def search(spark: SparkSession, path: str, schema: T.StructType, term: str, columns: list[str] | None = None) -> DataFrame:
    """The stored rows of which a column holds ``term`` (P13), ignoring case."""
    columns = columns or schema.names
    rows = _rows(spark, path, schema)
    if term_pieces(term):
        rows = rows.join(candidates(spark, path, term), [PART, PLACE], "left_semi")
    return rows.filter(holds(columns, term)).select(*schema.names)


def count_matches(spark: SparkSession, path: str, schema: T.StructType, term: str, columns: list[str]) -> DataFrame:
    """P14 'n of total': matches by the index, the total from the stored rows' footers."""
    total = _rows(spark, path, schema).select(F.count(F.lit(1))).scalar()
    return search(spark, path, schema, term, columns).agg(F.count(F.lit(1)).alias("matches")).withColumn("total", total)
