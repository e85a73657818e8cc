"""R2 with its refusals: every ticket line is booked once or refused with a reason.

``refuse_lines`` is a ``foreachBatch`` writer. A line is refused when its quantity or dish cannot be
sold (M8), when it is older than the newest line of earlier batches less ``delay`` ('late'), or
when its (ticket, line) was booked before ('repeated'); the others are booked. Batches write
``booked/batch_id=N`` and ``refused/batch_id=N``, and the keys that may still be repeated are
kept in hash buckets (``sources.buckets``): a batch rewrites only the buckets of its own keys and
drops keys there that are so old that a repeat would be late. A replayed batch reads the
state of earlier batches only, so it writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mise.operators.mutations import ticket_checks
from mise.sources.buckets import KeyedTable
from mise.streaming.tickets import TICKET_SCHEMA

KEYS = ["ticket_id", "line_no"]
LATE, REPEATED = "late", "repeated"


class Refusals:
    def __init__(self, spark: SparkSession, path: str, delay: str = "1 DAY", buckets: int = 64):
        self.spark, self.path, self.delay = spark, path, delay
        self.seen = KeyedTable(spark, f"{path}/seen", "ticket_id bigint, line_no int, ts timestamp", KEYS, buckets=buckets)
        self.newest = KeyedTable(spark, f"{path}/newest", "one int, ts timestamp", ["one"], buckets=1)

    def split(self, lines: DataFrame, batch_id: int) -> DataFrame:
        """The batch's lines with ``reason`` (NULL: booked). Of equal keys in one batch the earliest
        sellable line on time is booked."""
        newest = self.newest.read(batch_id).select(F.max("ts").alias("newest"))
        limit = newest.select(F.col("newest") - F.expr(f"INTERVAL {self.delay}")).scalar()
        why = None
        for reason, ok in [*ticket_checks(), ("no dish", F.col("dish_id").isNotNull())]:
            bad = ~F.coalesce(ok, F.lit(False))
            why = F.when(bad, reason) if why is None else why.when(bad, reason)
        first = lines.withColumn("reason", why.when(F.coalesce(F.col("ts") < limit, F.lit(False)), LATE))
        seen = self.seen.read(batch_id, self.seen.touched(lines)).select(*KEYS, F.lit(True).alias("booked_before"))
        rest = [c for c in lines.columns if c not in KEYS]
        turn = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("reason").isNotNull(), "ts", F.xxhash64(*rest)))
        j = first.withColumn("turn", turn).join(seen, KEYS, "left")
        again = F.col("booked_before").isNotNull() | (F.col("turn") > 1)
        return j.withColumn("reason", F.coalesce("reason", F.when(again, REPEATED))).select(*lines.columns, "reason")

    def write(self, lines: DataFrame, batch_id: int) -> None:
        lines = lines.persist()
        try:
            if lines.isEmpty():
                return
            split = self.split(lines, batch_id).persist()
            booked, refused = split.filter("reason IS NULL").drop("reason"), split.filter("reason IS NOT NULL")
            booked.write.mode("overwrite").parquet(f"{self.path}/booked/batch_id={batch_id}")
            refused.write.mode("overwrite").parquet(f"{self.path}/refused/batch_id={batch_id}")
            newest = lines.agg(F.max("ts").alias("ts")).unionByName(self.newest.read(batch_id).select("ts")).agg(F.max("ts").alias("ts"))
            touched = self.seen.touched(booked)
            # a key stays as long as a repeat of it could still be on time
            open_until = newest.select(F.col("ts") - F.expr(f"INTERVAL {self.delay}")).scalar()
            kept = self.seen.read(batch_id, touched).unionByName(booked.select(*KEYS, "ts")).filter(F.col("ts") >= open_until)
            self.seen.replace(kept, touched, batch_id)
            self.newest.apply_batch(newest.select(F.lit(1).alias("one"), "ts"), batch_id)
            split.unpersist()
        finally:
            lines.unpersist()

    def booked(self) -> DataFrame:
        return self.spark.read.schema(TICKET_SCHEMA).parquet(f"{self.path}/booked").select(*TICKET_SCHEMA.names)

    def refused(self) -> DataFrame:
        schema = T.StructType([*TICKET_SCHEMA.fields, T.StructField("reason", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/refused").select(*schema.names)


def refuse_lines(lines: DataFrame, path: str, checkpoint: str, delay: str = "1 DAY", buckets: int = 64) -> StreamingQuery:
    """A stream of ticket lines (ticket_id, line_no, ts, dish_id, quantity) into ``path``."""
    target = Refusals(lines.sparkSession, path, delay, buckets)
    return (lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(target.write)
            .trigger(availableNow=True).start())
