"""Stock with deliveries and stock-takes: runs against a replay, the stream against the batch."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from mise.operators import stock_moves as M
from mise.streaming import stock_ledger as L

MOVES = "name string, ts timestamp, seq bigint, kind string, amount decimal(12,2)"
ING = "name string, count decimal(12,2), min_stock decimal(12,2)"
DAY0 = dt.datetime(2024, 3, 1)


def some_moves(seed: int, n: int, names: str, minutes: int = 60 * 24 * 6):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        ts = DAY0 + dt.timedelta(minutes=rnd.randrange(minutes), microseconds=rnd.randrange(3))
        kind = rnd.choice(["sale"] * 6 + ["delivery"] * 2 + ["count"])
        for name in rnd.sample(names, rnd.randrange(1, 3)):
            rows.append((name, ts, seq, kind, D(rnd.randrange(0, 6000)) / 100))
            if rnd.random() < 0.2:          # a recipe that names an ingredient twice
                rows.append((name, ts, seq, kind, D(rnd.randrange(0, 500)) / 100))
    return rows


def replay(ing, rows):
    """(ledger rows, final stocks) by applying one move after the other."""
    together: dict = {}
    for name, ts, seq, kind, amount in rows:
        k = (name, ts, seq, M.KINDS[kind], kind)
        together[k] = max(together.get(k, amount), amount) if kind == "count" else together.get(k, D(0)) + amount
    stock, least, out = {n: c or D(0) for n, c, _ in ing}, {n: m for n, _, m in ing}, []
    for (name, ts, seq, _, kind), amount in sorted(together.items(), key=lambda x: (x[0][0], *x[0][1:4])):
        if name not in stock:
            continue
        before = stock[name]
        after = amount if kind == "count" else before + amount if kind == "delivery" else max(D(0), before - amount)
        low = least[name]
        alert = None if low is None or not before > low >= after else "SIN STOCK" if after <= 0 else "BAJO"
        stock[name] = after
        out.append((name, ts, seq, kind, amount, before, after, alert))
    return out, stock


def lasting(ledger, least, hold, until):
    out = []
    for name in {r[0] for r in ledger}:
        since, told = None, True
        for r in [x for x in ledger if x[0] == name]:
            if since is not None and not told and since + hold < r[1]:
                out.append((name, since + hold))
                told = True
            if r[7]:
                since, told = r[1], False
            elif least[name] is not None and r[6] > least[name]:
                since, told = None, True
        if since is not None and not told and since + hold < until:
            out.append((name, since + hold))
    return sorted(x for x in out if x[1] < until)


STOCK = [("rice", D("100"), D("20")), ("oil", D("-5"), D("10")), ("salt", D("3"), None), ("flour", None, D("0")),
         ("tea", D("40"), D("15"))]
NAMES = ["rice", "oil", "salt", "flour", "ghost"]


@pytest.mark.parametrize("seed, bucket", [(1, "hour"), (2, "day"), (3, "minute"), (4, "year")])
def test_runs_compose_to_the_replay(spark, seed, bucket):
    rows = some_moves(seed, 160, NAMES)
    ing = spark.createDataFrame(STOCK, ING)
    moves = spark.createDataFrame(rows, MOVES).repartition(5)
    want, final = replay(STOCK, rows)
    got = M.stock_ledger(ing, moves, bucket).collect()
    assert sorted((r["name"], r["ts"], r["seq"], r["kind"], r["amount"], r["before"], r["after"], r["alert"]) for r in got) == sorted(want)
    after = {r["name"]: r for r in M.stock_after_moves(ing, moves, bucket).collect()}
    assert set(after) == {n for n, _, _ in STOCK}
    for n, count, _ in STOCK:
        if n == "tea":
            assert after[n]["count_after"] == 40.0 and after[n]["sold"] == 0.0
        else:
            assert after[n]["count_after"] == float(final[n])
    until = DAY0 + dt.timedelta(days=5)
    seen = [r for r in want if r[1] < until]
    alerts = M.lasting_alerts(M.stock_ledger(ing, moves, bucket).filter(F.col("ts") < F.lit(until)), "1 DAY", F.lit(until))
    assert sorted((r["name"], r["ts"]) for r in alerts.collect()) == lasting(
        seen, {n: m for n, _, m in STOCK}, dt.timedelta(days=1), until)


def test_no_moves_and_one_delivery(spark):
    ing = spark.createDataFrame(STOCK, ING)
    none = spark.createDataFrame([], MOVES)
    assert {r["name"]: r["count_after"] for r in M.stock_after_moves(ing, none).collect()} == {
        "rice": 100.0, "oil": -5.0, "salt": 3.0, "flour": None, "tea": 40.0}
    one = spark.createDataFrame([("oil", DAY0, 1, "delivery", D("2")), ("tea", DAY0, 2, "unknown kind", D("2"))], MOVES)
    after = {r["name"]: r["count_after"] for r in M.stock_after_moves(ing, one).collect()}
    assert after["oil"] == -3.0 and after["tea"] == 40.0       # a delivery has no floor
    assert M.stock_ledger(ing, none).count() == 0


def test_a_hot_ingredient_is_folded_by_many_tasks(spark):
    """The per-ingredient step sees one row per bucket of time, not one per sale."""
    rows = [("rice", DAY0 + dt.timedelta(minutes=k), k, "sale" if k % 3 else "delivery", D(k % 7)) for k in range(3000)]
    ing, moves = spark.createDataFrame(STOCK, ING), spark.createDataFrame(rows, MOVES)
    _, runs = M._folded(moves, "hour")
    assert runs.count() == 50
    assert {r["name"]: r["count_after"] for r in M.stock_after_moves(ing, moves).collect()}["rice"] == float(replay(STOCK, rows)[1]["rice"])


def _land(spark, folder, k, rows):
    path = os.path.join(folder, f"f{k}")
    spark.createDataFrame(rows, MOVES).coalesce(1).write.parquet(path)
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    os.rename(os.path.join(path, part), os.path.join(folder, f"moves{k}.parquet"))
    os.utime(os.path.join(folder, f"moves{k}.parquet"), (1_700_000_000 + 10 * k,) * 2)


def test_stream_equals_batch_across_a_restart(spark, tmp):
    """Moves arrive shuffled within the delay, in four files; the query stops after two of them."""
    rows = sorted(some_moves(9, 220, NAMES), key=lambda r: r[1])
    rnd = random.Random(3)
    late = [(r[1] + dt.timedelta(minutes=rnd.randrange(600)), r) for r in rows]     # arrival, within half a day
    arrived = [r for _, r in sorted(late, key=lambda x: x[0])]
    # all rows of one event arrive together
    src, sink, ckpt = (os.path.join(tmp, x) for x in ("src", "sink", "ckpt"))
    os.makedirs(src)
    ing = spark.createDataFrame(STOCK, ING)
    cuts = [0, len(rows) // 4, len(rows) // 2, 3 * len(rows) // 4, len(rows)]
    seen = 0
    for stop in (2, 4):
        for k in range(seen, stop):
            _land(spark, src, k, arrived[cuts[k]:cuts[k + 1]])
        seen = stop
        stream = spark.readStream.schema(MOVES).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "moves*").parquet(src)
        q = L.start_ledger(stream, ing, sink, ckpt)
        q.awaitTermination(180)
        assert q.exception() is None
    until = max(r[1] for r in rows) - dt.timedelta(days=1)
    until = until.replace(microsecond=until.microsecond // 1000 * 1000)
    want, _ = replay(STOCK, rows)
    want = [r for r in want if r[1] < until]
    got = L.read_ledger(spark, sink).collect()
    moves = [tuple(r) for r in got if r["kind"] != "alert"]
    assert sorted(moves) == sorted(want)
    alerts = sorted((r["name"], r["ts"]) for r in got if r["kind"] == "alert")
    assert alerts == lasting(want, {n: m for n, _, m in STOCK}, dt.timedelta(days=1), until)
    assert alerts and len(set(alerts)) == len(alerts)


def test_stream_in_a_session_that_names_another_state_store(spark, tmp):
    """A session of the caller's, without ``SCALE_CONF``: Spark's default store holds one state only."""
    name = "spark.sql.streaming.stateStore.providerClass"
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    rows = some_moves(5, 60, NAMES)
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    _land(spark, src, 0, rows)
    before = spark.conf.get(name)
    spark.conf.set(name, other)
    try:
        stream = spark.readStream.schema(MOVES).option("pathGlobFilter", "moves*").parquet(src)
        q = L.start_ledger(stream, spark.createDataFrame(STOCK, ING), os.path.join(tmp, "sink"), os.path.join(tmp, "ckpt"))
        q.awaitTermination(180)
        assert q.exception() is None
        assert spark.conf.get(name) == other
    finally:
        spark.conf.set(name, before)
    until = max(r[1] for r in rows) - dt.timedelta(days=1)
    until = until.replace(microsecond=until.microsecond // 1000 * 1000)
    want = [r for r in replay(STOCK, rows)[0] if r[1] < until]
    got = L.read_ledger(spark, os.path.join(tmp, "sink")).filter("kind <> 'alert'").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
