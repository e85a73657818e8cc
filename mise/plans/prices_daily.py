"""The daily competitor-price job as one Spark job.

The reference scrapes store by store on the driver, merges real and estimated rows
in a Python loop, deletes the day and appends. Here the landed search responses
are parsed on the executors (S4 JSON, S5 HTML), rows with no positive price are
rejected (M8), real rows beat estimates per (ingredient, store), estimates being
used where the caller asks for them (U1/G3), the day's partition is replaced (K2, idempotent) and the day's store summary (A23) is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.operators import mutations as M
from mise.operators import prices as PR
from mise.sources import parsers as PS
from mise.sources.sinks import replace_days


def daily_prices(json_responses: DataFrame, html_pages: DataFrame, ing: DataFrame, day: str,
                 out_path: str, use_estimates: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (the day's stored rows, the day's store summary)."""
    d = F.lit(day).cast("date")
    real = (PS.parse_store_json(json_responses, d)
            .unionByName(PS.parse_store_html(html_pages, d))
            .withColumn("presentacion", F.lit(None).cast("string")))
    good, _rejected = M.split_valid(real, M.price_checks())
    rows = PR.real_over_seed(good, PR.seed_prices(ing, day), use_estimates)
    replace_days(rows, out_path, days=[day])
    stored = rows.sparkSession.read.parquet(out_path).filter(F.col("fecha_scrape") == d)
    return stored, PR.store_summary(stored, day)
