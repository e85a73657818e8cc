"""R3 as a stateful processor: the stock ledger of every ingredient, kept by event time.

``StockProcessor`` (``transformWithStateInPandas``, keyed by ``BUCKETS`` buckets of ingredients) holds
each ingredient's stock, its minimum and the moves that the watermark has not reached. Stocks do not
commute with deliveries and stock-takes, so moves wait in the state until the watermark has passed
them and then apply in the order of ``operators.stock_moves``: whatever the order of arrival, the
ledger is that of the batch. An event-time timer per bucket wakes it for the next waiting move and
for the next alert that is due when a stock stayed low for ``hold``; a delivery that lifts the
stock before takes that alert back. The stock starts from the ingredient table (initial state) and
survives restarts in the query's checkpoint; rows later than the watermark are dropped by Spark.

A call to the state store is a round trip between Python and the JVM, so a bucket's ingredients are
one value and its waiting moves come in parts of ``PART``: the calls follow the buckets, not the
ingredients or moves. Moves that come before anything is due are appended without reading the rest.
A checkpoint belongs to its ``BUCKETS``; one of a state by ingredient cannot be taken on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mise.operators.stock_moves import KINDS
from mise.session import SCALE_CONF

# The processor travels to the Python workers by value (no package install needed).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: amounts in hundredths, times in microseconds; ``alert`` rows carry no move
LEDGER = "name string, ts_us bigint, seq bigint, kind string, amount bigint, before bigint, after bigint, alert string"
#: what a bucket keeps of each ingredient, and of each waiting move besides its ingredient's place
STOCK = pa.schema([("name", pa.string()), ("stock", pa.int64()), ("minimum", pa.int64()), ("low_since", pa.int64()),
                   ("told", pa.bool_())])
MOVE = ["ts_us", "seq", "rank", "amount"]
BUCKETS, PART = 4096, 1 << 15
NAMES = {r: k for k, r in KINDS.items()}
STORE = "spark.sql.streaming.stateStore.providerClass"


def _hundredths(c) -> F.Column:
    return (F.col(c) * 100).cast("bigint")


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _packed(columns: list, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked(data) -> list:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().columns


def _merged(moves: list[np.ndarray]) -> list[np.ndarray]:
    """(place, ts, seq, rank, amount) in the order they apply; moves of one event and kind are one move."""
    place, ts, seq, rank, amount = moves
    order = np.lexsort((rank, seq, ts, place))
    place, ts, seq, rank, amount = (c[order] for c in moves)
    if not len(place):
        return [place, ts, seq, rank, amount]
    begins = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(ts) != 0) | (np.diff(seq) != 0) | (np.diff(rank) != 0)])
    total = np.where(rank[begins] == KINDS["count"], np.maximum.reduceat(amount, begins), np.add.reduceat(amount, begins))
    return [place[begins], ts[begins], seq[begins], rank[begins], total]


class StockProcessor(StatefulProcessor):
    def __init__(self, hold_ms: int):
        self.hold_us = hold_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stocks = handle.getValueState("stocks", "rows binary")
        self.waiting = handle.getListState("moves", "rows binary")
        self.wake = handle.getValueState("wake", "at_ms bigint")
        self.moves = pa.schema([("place", pa.int64()), *((c, pa.int64()) for c in MOVE)])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = self._stocks() if self.stocks.exists() else [[] for _ in STOCK]
        known = set(rows[0])
        columns = (initialState[c].tolist() for c in ("name", "stock", "minimum", "bounded"))
        for name, stock, minimum, bounded in zip(*columns):
            name = name if isinstance(name, str) else None
            if name not in known:
                known.add(name)
                # low from the beginning is no fall: nothing to tell
                for column, value in zip(rows, (name, int(stock), int(minimum) if bounded else None, None, True)):
                    column.append(value)
        self.stocks.update((_packed(rows, STOCK),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        names, new = [], []
        for part in rows:
            if part[MOVE].isna().to_numpy().any():
                raise ValueError("a move lacks its time, number or amount")
            names += part["name"].tolist()
            new.append(part[MOVE].to_numpy(np.int64))
        if self.stocks.exists():        # an ingredient without a stock row has no ledger
            stocks, new = self._stocks(), np.concatenate(new)
            place = {name: i for i, name in enumerate(stocks[0])}
            own = np.array([place.get(n if isinstance(n, str) else None, -1) for n in names], np.int64)
            yield from self._catch_up(stocks, [own[own >= 0], *new[own >= 0].T], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._catch_up(self._stocks(), [np.zeros(0, np.int64)] * 5, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _stocks(self) -> list[list]:
        return [c.to_pylist() for c in _unpacked(self.stocks.get()[0])]

    def _wait(self, moves: list[np.ndarray]) -> list[tuple]:
        return [(_packed([c[at:at + PART] for c in moves], self.moves),) for at in range(0, len(moves[0]), PART)]

    def _wake(self, before: int | None, due: list[int], watermark_ms: int) -> None:
        wake = max(min(due), watermark_ms + 1) if due else None
        if wake == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if wake is None:
            self.wake.clear()
        else:
            self.handle.registerTimer(wake)
            self.wake.update((wake,))

    def _catch_up(self, stocks: list[list], moves: list[np.ndarray], watermark_ms: int) -> Iterator:
        """Apply what the watermark has passed; keep the rest and set the next timer."""
        import pandas as pd
        wake = self.wake.get()[0] if self.wake.exists() else None
        if (wake is None or wake > watermark_ms) and (moves[1] // 1000 >= watermark_ms).all():
            if len(moves[0]):           # nothing is due
                for part in self._wait(moves):
                    self.waiting.appendValue(part)
                self._wake(wake, [int(moves[1].min()) // 1000 + 1, *([] if wake is None else [wake])], watermark_ms)
            return
        kept = [[c.to_numpy() for c in _unpacked(part[0])] for part in self.waiting.get()]
        moves = _merged([np.concatenate(c) for c in zip(moves, *kept)])
        passed = moves[1] // 1000 < watermark_ms
        names, stock_of, minimum_of, low_of, told_of = stocks
        out: list[list] = [[] for _ in range(8)]

        def write(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def tell(i: int, now_us: int) -> None:
            if low_of[i] is not None and not told_of[i] and low_of[i] + self.hold_us < now_us:
                write(names[i], low_of[i] + self.hold_us, None, "alert", None, None, stock_of[i],
                      "SIN STOCK" if stock_of[i] <= 0 else "BAJO")
                told_of[i] = True

        for i, ts, seq, rank, amount in zip(*(c[passed].tolist() for c in moves)):
            tell(i, ts)
            before, minimum = stock_of[i], minimum_of[i]
            stock = amount if rank == KINDS["count"] else before + amount if rank == KINDS["delivery"] else max(0, before - amount)
            alert = None
            if minimum is not None and before > minimum >= stock:
                alert, low_of[i], told_of[i] = "SIN STOCK" if stock <= 0 else "BAJO", ts, False
            elif minimum is not None and stock > minimum:
                low_of[i], told_of[i] = None, True
            stock_of[i] = stock
            write(names[i], ts, seq, NAMES[rank], amount, before, stock, alert)
        for i, told in enumerate(told_of):
            if not told:
                tell(i, watermark_ms * 1000)
        rest = [c[~passed] for c in moves]
        due = [int(rest[1].min()) // 1000 + 1] if len(rest[0]) else []
        due += [(low + self.hold_us) // 1000 + 1 for low, told in zip(low_of, told_of) if low is not None and not told]
        self._wake(wake, due, watermark_ms)
        if out[0]:
            self.stocks.update((_packed(stocks, STOCK),))
        if len(rest[0]):
            self.waiting.put(self._wait(rest))
        else:
            self.waiting.clear()
        if out[0]:
            columns = [c.split()[0] for c in LEDGER.split(", ")]
            yield pd.DataFrame({c: pd.array(v, "Int64") if c in ("seq", "amount", "before") else v
                                for c, v in zip(columns, out)})


def ledger_stream(moves: DataFrame, ing: DataFrame, delay: str = "1 day", hold_ms: int = 86_400_000) -> DataFrame:
    """Ledger and lasting alerts of a stream of moves (name, ts, seq, kind, amount)."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in KINDS.items()))
    rows = moves.filter(F.col("kind").isin(*KINDS)).withWatermark("ts", delay).select(
        _bucket(), "name", "ts", F.unix_micros("ts").alias("ts_us"), "seq", rank.alias("rank"), _hundredths("amount").alias("amount"))
    start = ing.select(_bucket(), "name", F.coalesce(_hundredths("count"), F.lit(0)).alias("stock"),
                       F.coalesce(_hundredths("min_stock"), F.lit(0)).alias("minimum"), F.col("min_stock").isNotNull().alias("bounded"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        StockProcessor(hold_ms), outputStructType=LEDGER, outputMode="Append", timeMode="EventTime",
        initialState=start.groupBy("bucket"))


def start_ledger(moves: DataFrame, ing: DataFrame, sink: str, checkpoint: str, delay: str = "1 day",
                 hold_ms: int = 86_400_000) -> StreamingQuery:
    """The ledger to a parquet sink, up to what is there now. The processor's several states need
    a RocksDB store, whatever the session names; a stream takes the session's settings as it starts."""
    conf = moves.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, SCALE_CONF[STORE])
    try:
        return (ledger_stream(moves, ing, delay, hold_ms).writeStream.outputMode("append").format("parquet")
                .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            conf.unset(STORE)
        else:
            conf.set(STORE, before)


def read_ledger(spark, sink: str) -> DataFrame:
    """The written ledger in the batch's types."""
    amount = lambda c: (F.col(c) / 100).cast("decimal(18,2)").alias(c)
    return spark.read.schema(LEDGER).parquet(sink).select(
        "name", F.timestamp_micros("ts_us").alias("ts"), "seq", "kind", amount("amount"), amount("before"), amount("after"), "alert")
