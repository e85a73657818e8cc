"""Stock over time with sales, deliveries and stock-takes (A28 across restocks, SURVEY 2.11-c).

A sale takes ``x`` to ``max(0, x - grams)``, a delivery to ``x + grams`` and a stock-take to the
counted value. Each is ``x -> max(lo, x + d)`` (a stock-take forgets ``x``), and so is any run of
them in order: with the running sum S of the d's, the value after the k-th is
``S_k + max(x, max over j <= k of (lo_j - S_j))``, ``x`` counting only before the first
stock-take. Sums and maxima of a run are found on their own and runs compose by the same
formula, so a history is folded per (ingredient, ``bucket`` of time) first and then over each
ingredient's buckets: an ingredient that every dish uses is spread over as many tasks as it has
buckets, and the second step sees one row per bucket, however many sales there were.

Moves: ``name, ts, seq, kind ('sale' | 'delivery' | 'count'), amount``. They apply in the order
(ts, seq, count before delivery before sale); moves of one event and kind are added up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mise.functions.expr import stock_state_report

GRAMS = "decimal(18,2)"
SUM = "decimal(28,2)"
#: Order of moves with one time and sequence number.
KINDS = {"count": 0, "delivery": 1, "sale": 2}


def event_moves(events: DataFrame, items: DataFrame) -> DataFrame:
    """Moves of dish events (``seq, ts, kind, dish_id, quantity, counted``): a sale uses the
    recipe's grams, a delivery brings them, a stock-take counts each of its ingredients."""
    lines = items.select("dish_id", F.col("ingredient_name").alias("name"), "quantity_grams")
    amount = F.when(F.col("kind") == "count", F.col("counted").cast(GRAMS)).otherwise(
        (F.col("quantity_grams") * F.col("quantity")).cast(GRAMS))
    return events.join(lines, "dish_id").select("name", "ts", "seq", "kind", amount.alias("amount"))


def ordered_moves(moves: DataFrame) -> DataFrame:
    """One row per (name, ts, seq, kind) with its order among the moves of one event."""
    total = F.when(F.col("kind") == "count", F.max("amount")).otherwise(F.sum("amount"))
    rank = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in KINDS.items()))
    return moves.filter(F.col("kind").isin(*KINDS)).groupBy("name", "ts", "seq", "kind").agg(
        total.cast(GRAMS).alias("amount")).withColumn("rank", rank)


def _runs(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds, for each row with (forgets, d, lo), what the run of the rows so far makes of a value
    ``x`` before it: ``total + max(floor, x)``, x counting only where ``forgotten`` is 0."""
    so_far = (Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("forgotten", F.sum("forgets").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(*so_far)))
    since = Window.partitionBy(*group, "forgotten").orderBy(*order).rowsBetween(*so_far)
    df = df.withColumn("total", F.sum("d").over(since).cast(SUM))
    return df.withColumn("floor", F.max(F.col("lo") - F.col("total")).over(since).cast(SUM))


def _after(x: Column) -> Column:
    """The value that a run leaves of ``x`` (``greatest`` passes over a missing floor)."""
    return (F.col("total") + F.greatest("floor", F.when(F.col("forgotten") == 0, x))).cast(GRAMS)


def _folded(moves: DataFrame, bucket: str) -> tuple[DataFrame, DataFrame]:
    """(each move with the run since its bucket began, one run per ingredient and bucket)."""
    kind, amount = F.col("kind"), F.col("amount")
    steps = ordered_moves(moves).withColumn("bucket", F.date_trunc(bucket, "ts")).withColumns({
        "forgets": (kind == "count").cast("int"),
        "d": F.when(kind == "sale", -amount).when(kind == "delivery", amount).otherwise(0).cast(SUM),
        "lo": F.when(kind == "sale", F.lit(0)).when(kind == "count", amount).cast(SUM)})
    each = _runs(steps, ["name", "bucket"], ["ts", "seq", "rank"])
    last = each.groupBy("name", "bucket").agg(F.max_by(
        F.struct("forgotten", "total", "floor"), F.struct("ts", "seq", "rank")).alias("r"),
        *(F.sum(F.when(kind == k, amount)).alias(k) for k in ("sale", "delivery")))
    # a run is a step again: what it adds, its least value, whether it forgets what was before
    runs = last.select("name", "bucket", "sale", "delivery", (F.col("r.forgotten") > 0).cast("int").alias("forgets"),
                       F.when(F.col("r.forgotten") > 0, F.lit(0).cast(SUM)).otherwise(F.col("r.total")).alias("d"),
                       (F.col("r.floor") + F.col("r.total")).cast(SUM).alias("lo"))
    return each, _runs(runs, ["name"], ["bucket"])


def _start(ing: DataFrame) -> DataFrame:
    return ing.select("name", F.coalesce("count", F.lit(0)).cast(GRAMS).alias("start"), "min_stock")


def stock_after_moves(ing: DataFrame, moves: DataFrame, bucket: str = "hour") -> DataFrame:
    """Stock of every ingredient after all its moves; untouched ones keep their count. Moves of
    unknown ingredients change nothing."""
    _each, runs = _folded(moves, bucket)
    last = runs.groupBy("name").agg(
        F.max_by(F.struct("forgotten", "total", "floor"), F.col("bucket")).alias("r"),
        F.sum("sale").alias("sale"), F.sum("delivery").alias("delivery")).select("name", "r.*", "sale", "delivery")
    j = ing.select("name", "count", "min_stock").join(last, "name", "left")
    after = F.when(F.col("total").isNull(), F.col("count").cast(GRAMS)).otherwise(
        _after(F.coalesce(F.col("count"), F.lit(0)).cast(GRAMS)))
    return j.select("name", F.col("count").cast("double").alias("count_before"),
                    F.coalesce("sale", F.lit(0)).cast("double").alias("sold"),
                    F.coalesce("delivery", F.lit(0)).cast("double").alias("delivered"),
                    after.cast("double").alias("count_after"),
                    stock_state_report(after, F.col("min_stock")).alias("estado"))


def stock_ledger(ing: DataFrame, moves: DataFrame, bucket: str = "hour") -> DataFrame:
    """Every move of a known ingredient with the stock before and after it, and the alert that
    it raises: 'SIN STOCK' or 'BAJO' when the stock falls to the minimum or below from above."""
    each, runs = _folded(moves, bucket)
    by_time = Window.partitionBy("name").orderBy("bucket")
    before = runs.join(_start(ing), "name").withColumn("left", _after(F.col("start"))).select(
        "name", "bucket", "min_stock", F.coalesce(F.lag("left").over(by_time), F.col("start")).alias("opening"))
    rows = each.join(before, ["name", "bucket"]).withColumn("after", _after(F.col("opening")))
    in_bucket = Window.partitionBy("name", "bucket").orderBy("ts", "seq", "rank")
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(in_bucket), F.col("opening")))
    fell = (F.col("before") > F.col("min_stock")) & (F.col("after") <= F.col("min_stock"))
    return rows.select("name", "ts", "seq", "kind", "amount", "before", "after", "min_stock",
                       F.when(fell, F.when(F.col("after") <= 0, "SIN STOCK").otherwise("BAJO")).alias("alert"))


def lasting_alerts(ledger: DataFrame, hold: str, until: Column) -> DataFrame:
    """Alerts for stock that stays at or below its minimum for ``hold`` after it fell there:
    one per fall, due ``hold`` later if that is before ``until`` and no move lifted the stock
    above the minimum until then."""
    low = F.col("after") <= F.col("min_stock")
    turns = ledger.filter((F.col("before") <= F.col("min_stock")) != low)
    next_turn = F.lead("ts").over(Window.partitionBy("name").orderBy("ts", "seq", "rank"))
    rank = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in KINDS.items()))
    due = F.col("ts") + F.expr(f"INTERVAL {hold}")
    falls = turns.withColumn("rank", rank).withColumn("lifted", next_turn).filter("alert IS NOT NULL")
    return falls.select("name", due.alias("ts"), F.col("ts").alias("low_since"), F.col("lifted")).filter(
        (F.col("ts") < until) & (F.col("lifted").isNull() | (F.col("lifted") > F.col("ts")))).drop("lifted")
