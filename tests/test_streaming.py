"""Structured Streaming jobs against their batch twins (FIXTURES part C).

Five parquet files, read one per trigger with ``availableNow``:
  0: tickets 0-8, day 1 + id % 3, quantity 1   (three a day, days 1-3)
  1: (0, day 1), (1, day 2)                     repeats, dropped by R2
  2: (20, day 6, quantity 2)                    moves the watermark (delay 1 day) to day 5
  3: (30, day 1, 9) late -> dropped; (31, day 6, 1) on time
  4: (40, day 20, 1)                            closes day 6; day 20 stays open
"""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from mise.operators import sales as S
from mise.streaming import tickets as R

FILES = [
    [(i, 1 + i % 3, 1) for i in range(9)],
    [(0, 1, 1), (1, 2, 1)],
    [(20, 6, 2)],
    [(30, 1, 9), (31, 6, 1)],
    [(40, 20, 1)],
]
EXPECTED_R1 = [(dt.date(2024, 1, 1), 3, 3), (dt.date(2024, 1, 2), 3, 3),
               (dt.date(2024, 1, 3), 3, 3), (dt.date(2024, 1, 6), 3, 2)]


def _write_files(spark, folder, which):
    """One parquet file per fixture file, with ascending modification times."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(folder, exist_ok=True)
    schema = pa.schema([("ticket_id", pa.int64()), ("line_no", pa.int32()), ("ts", pa.timestamp("us", tz="UTC")),
                        ("dish_id", pa.int64()), ("quantity", pa.int32())])
    for k in which:
        rows = [(tid, 1, dt.datetime(2024, 1, day, 12, 0, tzinfo=dt.timezone.utc), 5 * (tid % 3), q)
                for tid, day, q in FILES[k]]
        table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
        dst = os.path.join(folder, f"file{k}.parquet")
        pq.write_table(table, dst)
        t = 1_700_000_000 + k * 10
        os.utime(dst, (t, t))


def _run_day_totals(spark, src, sink, ckpt):
    q = R.start_day_totals(R.read_ticket_files(spark, src), sink, ckpt)
    q.awaitTermination(120)
    assert q.exception() is None


def test_day_totals_stream(spark, tmp):
    src, sink, ckpt = (os.path.join(tmp, x) for x in ("src", "sink", "ckpt"))
    _write_files(spark, src, range(5))
    _run_day_totals(spark, src, sink, ckpt)
    got = sorted((r["day"], r["units"], r["tickets"]) for r in spark.read.parquet(sink).collect())
    assert got == EXPECTED_R1


def test_day_totals_restart_from_checkpoint(spark, tmp):
    src, sink, ckpt = (os.path.join(tmp, x) for x in ("src", "sink", "ckpt"))
    _write_files(spark, src, [0, 1, 2])
    _run_day_totals(spark, src, sink, ckpt)
    _write_files(spark, src, [3, 4])
    _run_day_totals(spark, src, sink, ckpt)
    got = sorted((r["day"], r["units"], r["tickets"]) for r in spark.read.parquet(sink).collect())
    assert got == EXPECTED_R1


def test_day_totals_batch_twin_on_time_rows(spark):
    rows = [(tid, 1, dt.datetime(2024, 1, day, 12), 0, q) for f in FILES for tid, day, q in f if tid != 30]
    got = sorted(tuple(r) for r in R.day_totals_batch(
        spark.createDataFrame(rows, R.TICKET_SCHEMA)).filter(F.col("day") < dt.date(2024, 1, 20)).collect())
    assert got == EXPECTED_R1


ITEMS = ("id bigint, dish_id bigint, menu_item_id bigint, ingredient_name string, "
         "quantity_grams decimal(10,2), unit_cost decimal(10,4)")
ING = "name string, count decimal(12,2), cost decimal(12,2), min_stock decimal(12,2)"


def test_running_stock_equals_batch_depletion(spark, tmp):
    src, sink, ckpt = (os.path.join(tmp, x) for x in ("src", "stock", "ckpt"))
    _write_files(spark, src, range(5))
    items = spark.createDataFrame([(1, 0, None, "rice", D("10"), None), (2, 5, None, "rice", D("4"), None),
                                   (3, 5, None, "oil", D("1"), None), (4, 10, None, "salt", D("100"), None)],
                                  ITEMS)
    ing = spark.createDataFrame([("rice", D("100"), D("1"), D("20")), ("oil", D("50"), D("1"), D("5")),
                                 ("salt", D("250"), D("1"), D("0")), ("flour", D("9"), D("1"), D("1"))], ING)
    q = R.running_stock(R.read_ticket_files(spark, src), items, ing, sink, ckpt)
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r["name"]: r["remaining"] for r in R.current_stock(spark, sink).collect()}

    # batch twin (A28) over the same lines: duplicates and the late row removed
    seen, lines = set(), []
    for f in FILES:
        for tid, day, qty in f:
            if tid in seen or tid == 30:
                continue
            seen.add(tid)
            lines.append((tid, tid, dt.datetime(2024, 1, day), 5 * (tid % 3), qty))
    priced = spark.createDataFrame(lines, "ticket_id bigint, line_id bigint, ts timestamp, dish_id bigint, "
                                          "quantity int").withColumn("dish_found", F.lit(True))
    totals = priced.groupBy("ticket_id").agg(F.lit(True).alias("accepted"))
    ing_full = ing.select("name", "count")
    want = {r["name"]: r["count_after"] for r in S.deplete_stock(ing_full, priced, totals, items).collect()}
    assert got == {k: v for k, v in want.items() if k in got}
    assert got["salt"] == 0.0 and "flour" not in got


def test_multi_line_tickets_keep_all_lines(spark, tmp):
    """Two-line tickets: both lines count as units, the ticket counts once, and a
    replayed line is dropped."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    src, sink, ckpt = (os.path.join(tmp, x) for x in ("src", "sink", "ckpt"))
    os.makedirs(src)
    schema = pa.schema([("ticket_id", pa.int64()), ("line_no", pa.int32()),
                        ("ts", pa.timestamp("us", tz="UTC")), ("dish_id", pa.int64()), ("quantity", pa.int32())])
    utc = dt.timezone.utc
    batches = [[(1, 1, dt.datetime(2024, 1, 1, 9, tzinfo=utc), 5, 2), (1, 2, dt.datetime(2024, 1, 1, 9, tzinfo=utc), 10, 1)],
               [(1, 2, dt.datetime(2024, 1, 1, 9, tzinfo=utc), 10, 1), (2, 1, dt.datetime(2024, 1, 3, 9, tzinfo=utc), 5, 1)]]
    for k, rows in enumerate(batches):
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema),
                       os.path.join(src, f"f{k}.parquet"))
        os.utime(os.path.join(src, f"f{k}.parquet"), (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(R.TICKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = R.start_day_totals(stream, sink, ckpt)
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(sink).collect()]
    assert got == [(dt.date(2024, 1, 1), 3, 1)]


def test_ticket_posting_stream(spark, tmp):
    """Payload stream -> priced lines -> accepted tickets -> stock snapshots; equals the
    batch posting of the same (de-duplicated) tickets."""
    import json
    import pyarrow as pa
    import pyarrow.parquet as pq
    src, out, ckpt = (os.path.join(tmp, x) for x in ("src", "out", "ckpt"))
    os.makedirs(src)
    utc = dt.timezone.utc
    files = [
        [(1, dt.datetime(2024, 1, 1, 9, tzinfo=utc), [{"dish_id": 5, "quantity": 2}, {"dish_id": 10}]),
         (2, dt.datetime(2024, 1, 1, 10, tzinfo=utc), [{"dish_id": 10, "quantity": 3}])],
        [(1, dt.datetime(2024, 1, 1, 9, tzinfo=utc), [{"dish_id": 5, "quantity": 2}, {"dish_id": 10}]),   # retry
         (3, dt.datetime(2024, 1, 2, 9, tzinfo=utc), [{"dish_id": 5}, {"dish_id": 99}]),                  # unknown dish
         (4, dt.datetime(2024, 1, 2, 11, tzinfo=utc), [{"dish_id": 5, "quantity": 4}])],
    ]
    schema = pa.schema([("ticket_id", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("body", pa.string())])
    for k, rows in enumerate(files):
        path = os.path.join(src, f"t{k}.parquet")
        pq.write_table(pa.Table.from_pylist([{"ticket_id": a, "ts": b, "body": json.dumps(c)} for a, b, c in rows],
                                            schema=schema), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    menu = spark.createDataFrame([(5, "X", "FIVE", 1, "activo", D("0"), D("0"), D("100"), 1),
                                  (10, "X", "TEN", 2, "activo", D("0"), D("10"), D("50"), 1)],
                                 "id bigint, category string, dish_name string, sort_order int, status string, "
                                 "cost_total decimal(10,2), overhead_cost decimal(10,2), sale_price decimal(10,2), "
                                 "portion_weight_g int")
    items = spark.createDataFrame([(1, 5, None, "rice", D("100"), D("1")), (2, 10, None, "oil", D("30"), D("2"))],
                                  ITEMS)
    ing = spark.createDataFrame([("rice", D("650"), D("1"), "g"), ("oil", D("100"), D("1"), "g"),
                                 ("salt", D("7"), D("1"), "g")], "name string, count decimal(12,2), "
                                "cost decimal(12,2), measure string")
    payloads = spark.readStream.schema("ticket_id bigint, ts timestamp, body string") \
        .option("maxFilesPerTrigger", 1).parquet(src)
    q = R.post_ticket_stream(payloads, menu, items, ing, out, ckpt)
    q.awaitTermination(120)
    assert q.exception() is None
    sales = {r["ticket_id"]: (r["total_sale"], r["items_count"]) for r in spark.read.parquet(os.path.join(out, "sales")).collect()}
    assert sales == {1: (250.0, 3), 2: (150.0, 3), 4: (400.0, 4)}          # 3 rejected, retry of 1 dropped
    stock = {r["name"]: float(r["count"]) for r in R.latest_snapshot(spark, os.path.join(out, "stock")).collect()}
    # rice: 650 - 100*(2 + 4) = 50; oil: 100 - 30*(1 + 3) = 0 (floored); salt untouched
    assert stock == {"rice": 50.0, "oil": 0.0, "salt": 7.0}
