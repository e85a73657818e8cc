"""A hot key (a third of all sale lines on one sale id) is split by AQE's skew join
instead of landing in one task, and rollups reduce it map-side."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

from pyspark.sql import functions as F

from mise.operators import sales as S

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_sale_id_is_split(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        n = 30000
        lines = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("sale_id"),
            (F.col("id") % 50 * 5).alias("dish_id"), F.lit(1).alias("quantity"))
        heads = spark.range(n).select(F.col("id"), F.lit(dt.datetime(2024, 1, 1)).alias("created_at"))
        joined = S.sold_lines(heads, lines, "2023-01-01")
        daily = joined.groupBy("dish_id").agg(F.sum("quantity").alias("units"))
        got = {r["dish_id"]: r["units"] for r in daily.collect()}
        assert sum(got.values()) == n
        plain = lines.groupBy("dish_id").agg(F.sum("quantity").alias("units"))
        assert got == {r["dish_id"]: r["units"] for r in plain.collect()}
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            daily.explain()
        assert "skew=true" in buf.getvalue()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_rank_within_a_hot_group(spark):
    """Positions inside a group that holds most rows equal a brute-force numbering."""
    from mise.operators.mutations import rank_within
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.lit("small")).otherwise(F.lit("hot")).alias("category"),
        ((F.col("id") * 7919) % 100003).alias("id"))
    got = {(r["category"], r["id"]): r["rank_in_group"] for r in rank_within(df, "category", "id").collect()}
    rows = [(("small" if i % 4 == 0 else "hot"), (i * 7919) % 100003) for i in range(n)]
    want = {}
    for cat in ("small", "hot"):
        for pos, key in enumerate(sorted(k for c, k in rows if c == cat)):
            want[(cat, key)] = pos
    assert got == want
