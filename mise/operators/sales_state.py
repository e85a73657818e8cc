"""A6/A7/G1 kept up by changed days instead of a scan of the whole history.

Two tables in the shared folder: the daily series (dish, day, units) in monthly buckets, and per
(dish, weekday) the sums of G1 in hash buckets (``sources.buckets``, both replay-safe). A batch says
which days changed and gives all their rows as they are now: a new day, a late sale and a
correction are the same. The old rows of those days are read from their months; their sums are
subtracted and those of the new rows added, and only the touched buckets of sums are
rewritten. The sums are exact integers, so the state equals a full recompute for ever. The one
figure that cannot be subtracted, the last sale day, is looked up again for the (dish, weekday)
pairs whose last day lost its sales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mise.operators.projections import HORIZON, forecast_from_sums, weekday_sums
from mise.sources.buckets import KeyedTable

DAILY = "dish_id bigint, dia date, unidades bigint"
SUMS = "dish_id bigint, wd int, n bigint, st bigint, sy bigint, stt bigint, sty bigint, d1 date"
ADDED = ["n", "st", "sy", "stt", "sty"]


class SalesState:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        month = F.year("dia") * 100 + F.month("dia")
        self.daily_table = KeyedTable(spark, f"{path}/daily", DAILY, ["dish_id", "dia"], bucket_by=month)
        self.sums_table = KeyedTable(spark, f"{path}/sums", SUMS, ["dish_id", "wd"], buckets=buckets)

    def apply_days(self, daily: DataFrame, days: DataFrame, batch_id: int) -> None:
        """The rows (dish_id, dia, unidades) of all ``days`` (dia) as they are now; a day without
        rows has lost its sales. Batches are applied in the order of their ids; one that
        failed is applied again."""
        days = days.select(F.col("dia").cast("date").alias("dia")).distinct().persist()
        new = daily.select("dish_id", "dia", F.col("unidades").cast("bigint").alias("unidades")).join(days, "dia", "left_semi").persist()
        try:
            months = self.daily_table.touched(days)
            before = self.daily_table.read(batch_id, months)
            self._move_sums(before.join(days, "dia", "left_semi"), new, batch_id)
            self.daily_table.replace(before.join(days, "dia", "left_anti").unionByName(new.select(*before.columns)), months, batch_id)
        finally:
            new.unpersist()
            days.unpersist()

    def _move_sums(self, old: DataFrame, new: DataFrame, batch_id: int) -> None:
        keys = ["dish_id", "wd"]
        out = weekday_sums(old).select(*keys, *((-F.col(c)).alias(c) for c in ADDED), F.col("d1").alias("lost"),
                                       F.lit(None).cast("date").alias("won"))
        into = weekday_sums(new).select(*keys, *ADDED, F.lit(None).cast("date").alias("lost"), F.col("d1").alias("won"))
        moves = out.unionByName(into).groupBy(*keys).agg(*(F.sum(c).alias(f"d_{c}") for c in ADDED),
                                                         F.max("lost").alias("lost"), F.max("won").alias("won")).persist()
        try:
            touched = self.sums_table.touched(moves)
            # sums that lost all their rows have no last day
            now = self.sums_table.read(batch_id, touched).withColumn("d1", F.when(F.col("n") > 0, F.col("d1")))
            j = moves.join(now, keys, "left")
            moved = j.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) + F.col(f"d_{c}") for c in ADDED), "d1", "lost", "won")
            moved = moved.toDF(*keys, *ADDED, "d1", "lost", "won")
            # the last day went and no new row is as late: look it up in the days that stay
            open_ = (F.col("n") > 0) & (F.col("lost") == F.col("d1")) & (F.coalesce(F.col("won") < F.col("lost"), F.lit(True)))
            asked = moved.filter(open_).select(*keys)
            moved = moved.withColumn("d1", F.when(~F.coalesce(open_, F.lit(False)), F.greatest("d1", "won")))
            if not asked.isEmpty():
                stay = self.daily_table.read(batch_id).join(old.select("dish_id", "dia"), ["dish_id", "dia"], "left_anti")
                rows = stay.select("dish_id", "dia").unionByName(new.select("dish_id", "dia"))
                last = rows.withColumn("wd", F.dayofweek("dia")).join(asked, keys, "left_semi").groupBy(*keys).agg(
                    F.max("dia").alias("last"))
                moved = moved.join(last, keys, "left").withColumn("d1", F.coalesce("d1", "last"))
            self.sums_table.apply_batch(moved.select(*keys, *ADDED, "d1"), batch_id)
        finally:
            moves.unpersist()

    def daily_units(self) -> DataFrame:
        """A6 from the state."""
        return self.daily_table.read()

    def units_by_dish(self, since: str) -> DataFrame:
        """A7 from the state: the months before ``since`` are not read."""
        year, month = map(int, since.split("-")[:2])
        months = [b for b in self.daily_table.versions() if b >= year * 100 + month]
        rows = self.daily_table.read(only=months).filter(F.col("dia") >= F.lit(since).cast("date"))
        return rows.groupBy("dish_id").agg(F.sum("unidades").alias("units"))

    def forecast(self, horizon: int = HORIZON) -> DataFrame:
        """G1 from the state: one row per (dish, weekday) is read, whatever the history's length."""
        return forecast_from_sums(self.sums_table.read().filter("n > 0"), horizon)
