"""The nightly forecast job as one Spark job.

The reference pulls the daily series to the driver with ``toPandas``, fits one model
per dish in a Python loop and PATCHes projections one row at a time. Here:
typed read (adapter views) -> A6 daily units -> G1 forecast per dish (aggregates on
the executors) -> G2 new units for the projection rows -> K1 full refresh of the
projection table. One write, no driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mise.operators import projections as P
from mise.operators import sales as S
from mise.plans.registry import Tables
from mise.sources.sinks import write_full


def nightly_forecast(spark: SparkSession, sf_dir: str, since: str, out_path: str,
                     updated_at: str) -> DataFrame:
    """Write the projection table with forecast units and return it (read back)."""
    t = Tables.of(spark, sf_dir)
    daily = S.daily_units(t.sales, t.sale_items, since)
    new_units = P.apply_forecast(t.proj_rows, P.forecast_units(daily))
    proj = (t.proj_rows.drop("projected_units")
            .join(new_units.select("id", "projected_units", "from_forecast"), "id", "left")
            .withColumn("updated_at", F.lit(updated_at).cast("date")))
    write_full(proj, out_path)
    return spark.read.parquet(out_path)
