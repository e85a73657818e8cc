"""Sinks (K1-K4) and the streaming writers."""

from __future__ import annotations

import csv
import datetime as dt
import glob
import os
from decimal import Decimal as D


from mise.sources import sinks as K
from mise.streaming import tickets as R


def test_write_full_replaces_rows_and_schema(spark, tmp):
    path = os.path.join(tmp, "t")
    K.write_full(spark.createDataFrame([(1, "a")], "id int, x string"), path)
    K.write_full(spark.createDataFrame([(2, 3.5)], "id int, y double"), path)
    df = spark.read.parquet(path)
    assert df.columns == ["id", "y"] and [tuple(r) for r in df.collect()] == [(2, 3.5)]


def test_inventory_export_csv(spark, tmp):
    ing = spark.createDataFrame([("A, B", D("2"), D("3.5"), "kg", None, "b", None, "p", D("1"))],
                                "name string, count decimal(12,2), cost decimal(12,2), measure string, "
                                "classification string, brand string, supplier string, presentation string, "
                                "min_stock decimal(12,2)")
    path = os.path.join(tmp, "csv")
    K.export_inventory(ing, path)
    rows = []
    for part in sorted(glob.glob(os.path.join(path, "*.csv"))):
        with open(part, newline="", encoding="utf-8") as fh:
            rows += list(csv.reader(fh))
    assert rows[0] == K.EXPORT_COLUMNS
    data = [r for r in rows if r != K.EXPORT_COLUMNS]
    assert len(data) == 1
    assert data[0][1] == "A, B" and data[0][8] == "7.0"


def test_run_log(spark, tmp):
    path = os.path.join(tmp, "log")
    for k in range(25):
        K.log_run(spark, path, "orders", k % 3, f"run {k}", at=dt.datetime(2024, 1, 1) + dt.timedelta(hours=k),
                  error_when_empty=True)
    last = K.latest_runs(spark, path).collect()
    assert len(last) == 20 and last[0]["message"] == "run 24"
    assert {r["status"] for r in last if r["items_count"] == 0} == {"error"}


PRICE = ("ingrediente string, supermercado string, producto string, presentacion string, "
         "precio decimal(12,2), url string, fecha_scrape date")


def test_daily_snapshot_sink_replays(spark, tmp):
    path = os.path.join(tmp, "prices")
    write = R.daily_snapshot_sink(path)
    b0 = spark.createDataFrame([("a", "Makro", "a", None, D("1"), "", dt.date(2024, 1, 1))], PRICE)
    b1 = spark.createDataFrame([("a", "Makro", "a", None, D("2"), "", dt.date(2024, 1, 2))], PRICE)
    write(b0, 0)
    write(b1, 1)
    write(b1, 1)          # replayed micro-batch
    got = sorted((r["fecha_scrape"], r["precio"]) for r in spark.read.parquet(path).collect())
    assert got == [(dt.date(2024, 1, 1), D("1.00")), (dt.date(2024, 1, 2), D("2.00"))]


def test_keyed_snapshot_sink(spark, tmp):
    path = os.path.join(tmp, "products")
    write = R.keyed_snapshot_sink(path, ["slug"], order="seq")
    b0 = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "slug string, price double, seq int")
    b1 = spark.createDataFrame([("a", 5.0, 2), ("a", 6.0, 3), ("c", 7.0, 1)], "slug string, price double, seq int")
    write(b0, 0)
    write(b1, 1)
    write(b1, 1)          # replay of the same batch gives the same snapshot
    latest = R.latest_snapshot(spark, path)
    assert sorted(tuple(r) for r in latest.collect()) == [("a", 6.0), ("b", 2.0), ("c", 7.0)]
