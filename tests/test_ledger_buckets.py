"""The stock ledger's state: by bucket of ingredients, not by ingredient."""

import datetime as dt
import os
from decimal import Decimal as D

from mise.streaming import stock_ledger as L
from test_stock_moves import ING, _land, lasting, replay, some_moves


def test_state_follows_buckets_not_ingredients(spark, tmp, monkeypatch):
    """200 ingredients in 3 buckets; three files, so that moves wait, are appended to and catch up."""
    monkeypatch.setattr(L, "BUCKETS", 3, raising=False)
    names = [f"ingredient {k}" for k in range(200)]
    stock = [(n, D(k % 40), None if k % 7 == 0 else D(k % 9)) for k, n in enumerate(names)]
    rows = sorted(some_moves(4, 1500, names), key=lambda r: r[1])
    rows += [("unknown", *rows[-1][1:])]
    src, sink = os.path.join(tmp, "src"), os.path.join(tmp, "sink")
    os.makedirs(src)
    for k in range(3):
        _land(spark, src, k, rows[k * 500:None if k == 2 else (k + 1) * 500])
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "moves*").parquet(src)
    q = L.start_ledger(stream, spark.createDataFrame(stock, ING), sink, os.path.join(tmp, "ckpt"))
    q.awaitTermination(240)
    assert q.exception() is None
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert state and max(state) <= 6 * L.BUCKETS        # stocks, wake, timers and a few parts of moves
    until = max(r[1] for r in rows) - dt.timedelta(days=1)
    until = until.replace(microsecond=until.microsecond // 1000 * 1000)
    want = [r for r in replay(stock, [r for r in rows if r[0] != "unknown"])[0] if r[1] < until]
    got = L.read_ledger(spark, sink).collect()
    assert want and sorted(tuple(r) for r in got if r["kind"] != "alert") == sorted(want)
    alerts = sorted((r["name"], r["ts"]) for r in got if r["kind"] == "alert")
    assert alerts and alerts == lasting(want, {n: m for n, _, m in stock}, dt.timedelta(days=1), until)
