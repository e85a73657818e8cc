"""Structured Streaming jobs for the ticket feed.

* R1 ``day_totals``: tumbling one-day windows of tickets with an event-time
  watermark, append mode - a day is emitted once the watermark passes its end, and
  rows older than the watermark are dropped.
* R2 ``dedupe``: at most once per ticket id (``dropDuplicatesWithinWatermark``);
  the reference would book a retried ticket twice.
* R3 ``running_stock``: grams used per ingredient as a streaming aggregation (state
  kept by Spark in the checkpoint, keyed by ingredient), turned into remaining stock
  and low-stock alerts per micro-batch. Depletion commutes (sum, then one floor), so
  arrival order does not matter.
* R4 ``daily_snapshot_sink`` / ``keyed_snapshot_sink``: ``foreachBatch`` writers that
  replace the days of a batch (K2) or merge a batch into a keyed table (M1); both are
  idempotent, so a micro-batch replayed after a failure writes the same rows.

Every query takes its checkpoint folder from the caller; the default is a sub-folder
of the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mise.functions.expr import MONEY, stock_state_report
from mise.operators.mutations import upsert
from mise.session import scratch_path
from mise.sources.sinks import replace_days

TICKET_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.LongType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("dish_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
])


def read_ticket_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of ticket lines (parquet, explicit schema)."""
    return (spark.readStream.schema(TICKET_SCHEMA)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def _line_keys(df: DataFrame) -> list[str]:
    """A ticket line is identified by the ticket id, plus its line number when the
    stream carries several lines per ticket."""
    return ["ticket_id"] + (["line_no"] if "line_no" in df.columns else [])


def dedupe(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """R2: watermark on the event time, then at most one row per ticket line (a
    retried ticket is booked once; rows older than the watermark are dropped)."""
    return (stream.withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(_line_keys(stream)))


def _ticket_count(df: DataFrame) -> F.Column:
    """Tickets = their first lines when lines are numbered, else one row per ticket."""
    if "line_no" in df.columns:
        return F.count_if(F.col("line_no") == 1)
    return F.count(F.lit(1))


def day_totals(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """R1 (+R2): per one-day window: units and tickets; appended when the day closes."""
    d = dedupe(stream, delay)
    return d.groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.sum("quantity").cast("bigint").alias("units"),
        _ticket_count(d).alias("tickets")).select(
        F.to_date(F.col("w.start")).alias("day"), "units", "tickets")


def day_totals_batch(lines: DataFrame) -> DataFrame:
    """R1 batch twin: the same totals over a static, de-duplicated frame."""
    d = lines.dropDuplicates(_line_keys(lines))
    return d.groupBy(F.to_date("ts").alias("day")).agg(
        F.sum("quantity").cast("bigint").alias("units"), _ticket_count(d).alias("tickets"))


def grams_used(stream: DataFrame, items: DataFrame, delay: str = "1 day") -> DataFrame:
    """R3 state: grams used per ingredient so far (stream-static join with the recipes,
    then a keyed streaming aggregation; state size = number of ingredients)."""
    d = dedupe(stream, delay).select("dish_id", "quantity")
    j = d.join(items.select("dish_id", "ingredient_name", "quantity_grams"), "dish_id", "inner")
    return j.groupBy("ingredient_name").agg(
        F.sum(F.col("quantity_grams") * F.col("quantity")).alias("used"))


def stock_after(used: DataFrame, ing: DataFrame) -> DataFrame:
    """R3 per batch: remaining = max(0, count - used), with the P8 state and an alert
    flag for ingredients at or under their minimum."""
    j = used.join(ing.select("name", "count", "min_stock"),
                  used.ingredient_name == ing.name, "inner")
    remaining = F.greatest(F.lit(0), F.col("count") - F.col("used")).cast(MONEY)
    return j.select(
        "name", F.col("used").cast("double").alias("used"),
        remaining.cast("double").alias("remaining"),
        stock_state_report(remaining, F.col("min_stock")).alias("estado"),
        (remaining <= F.col("min_stock")).alias("alert"))


def running_stock(stream: DataFrame, items: DataFrame, ing: DataFrame, sink_path: str,
                  checkpoint: str, trigger_available_now: bool = True) -> StreamingQuery:
    """R3 query: every micro-batch merges the changed ingredients' remaining stock into
    the previous stock snapshot (keyed by name, replay-safe), so the current stock is
    one snapshot of ingredient-table size, however many batches have run."""
    used = grams_used(stream, items)
    merge = keyed_snapshot_sink(sink_path, ["name"])

    def write(batch: DataFrame, batch_id: int) -> None:
        merge(stock_after(batch, ing), batch_id)

    w = used.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def current_stock(spark: SparkSession, sink_path: str) -> DataFrame:
    """The current remaining stock per ingredient written by ``running_stock``."""
    return latest_snapshot(spark, sink_path)


def start_day_totals(stream: DataFrame, sink_path: str, checkpoint: str | None = None,
                     delay: str = "1 day") -> StreamingQuery:
    """R1 query to a parquet sink (append), ``availableNow`` trigger."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "r1_day_totals")
    return (day_totals(stream, delay).writeStream.outputMode("append").format("parquet")
            .option("path", sink_path).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())


def daily_snapshot_sink(path: str, day_col: str = "fecha_scrape"):
    """R4 for price snapshots: each micro-batch replaces its days (K2)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_days(batch, path, day_col)      # a batch replaces the days it brings
    return write


def keyed_snapshot_sink(path: str, keys: list[str], order: str | None = None):
    """R4 for keyed tables (products, orders): the batch is merged (M1) into the latest
    snapshot written by an earlier batch and stored as snapshot ``batch_id``. A replayed
    batch rebuilds the same snapshot from the same inputs, and never reads its own
    (possibly half-written) output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = latest_snapshot(spark, path, before=batch_id)
        if prev is None:
            prev = batch.limit(0).drop(*([order] if order else []))
        upsert(prev, batch, keys, order).write.mode("overwrite").parquet(
            os.path.join(path, f"snapshot={batch_id:012d}"))
    return write


def latest_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest snapshot under ``path`` (only snapshots older than ``before`` when
    given); None when there is none. The newest id is a scalar subquery, so only that
    partition folder is scanned."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None             # only a missing table is "no snapshot yet"; errors are errors
    snaps = spark.read.parquet(path)
    if before is not None:
        snaps = snaps.filter(F.col("snapshot") < before)
        if snaps.isEmpty():
            return None
    last = snaps.select(F.max("snapshot")).scalar()
    return snaps.filter(F.col("snapshot") == last).drop("snapshot")


def post_ticket_stream(payloads: DataFrame, menu: DataFrame, items: DataFrame, ing: DataFrame,
                       out_path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Point-of-sale write path as one stream: ticket payloads (ticket_id, ts, body) ->
    S10 lines -> R2 de-duplication -> per micro-batch A26 pricing, A27 ticket totals
    and A28 stock depletion.

    Writes per batch (all idempotent on replay): ``sales/batch_id=N`` (accepted
    tickets), ``sale_items/batch_id=N`` (their lines) and ``stock/snapshot=N`` - the
    stock after the batch, computed from the snapshot of an earlier batch (the first
    batch starts from ``ing``). Depletion floors once per batch, which equals the
    per-line floor because grams are never negative.
    """
    from mise.operators.sales import deplete_stock, post_sales, price_tickets
    from mise.sources.parsers import parse_tickets
    lines = dedupe(parse_tickets(payloads), delay)
    stock_path = os.path.join(out_path, "stock")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stock = latest_snapshot(spark, stock_path, before=batch_id)
        if stock is None:
            stock = ing.select("name", "count")
        batch = batch.withColumn("line_id", F.col("line_no"))
        # unit costs do not depend on stock; three writes read these lines
        priced = price_tickets(batch, menu, items, ing).persist()
        totals = post_sales(priced, batch)
        ok = totals.filter("accepted")
        ok.write.mode("overwrite").parquet(os.path.join(out_path, "sales", f"batch_id={batch_id}"))
        priced.join(ok.select("ticket_id"), "ticket_id", "left_semi").write.mode("overwrite").parquet(
            os.path.join(out_path, "sale_items", f"batch_id={batch_id}"))
        after = deplete_stock(stock, priced, totals, items).select(
            "name", F.col("count_after").cast("decimal(12,2)").alias("count"))
        after.write.mode("overwrite").parquet(os.path.join(stock_path, f"snapshot={batch_id:012d}"))
        priced.unpersist()

    return (lines.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())
