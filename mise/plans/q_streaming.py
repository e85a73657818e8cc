"""Registered streaming queries (R1-R3) over the whole ``events`` table.

Each query runs a Structured Streaming job with the ``availableNow`` trigger on a
file stream of the events parquet, writes to a fresh folder under the session's
``spark.checkpoint.dir`` and returns the sink read back as a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mise.operators import stock_moves as M
from mise.plans.oracle_views import with_views
from mise.plans.q_sales import LASTING_SQL, LEDGER_COLUMNS, MOVE_VIEWS, REPLAY_SQL, UNTIL_SQL, ledger_report
from mise.plans.registry import Tables, query
from mise.session import scratch_path
from mise.sources import adapters as A
from mise.streaming import stock_ledger as L
from mise.streaming import tickets as R

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _event_stream(spark, sf):
    return (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf))


def _parts(spark, sf):
    """The fixture's number of parts, a constant of a stream's plan."""
    return F.lit(Tables.of(spark, sf).raw("part").count())


def _ticket_stream(spark, sf):
    e = F.col("event_id")
    return _event_stream(spark, sf).filter(F.col("event_type") == "purchase").select(
        e.alias("ticket_id"), F.col("ts").cast("timestamp").alias("ts"),
        A.dish_of_event(e, _parts(spark, sf)).alias("dish_id"), (1 + F.col("user_id") % 4).cast("int").alias("quantity"))


@query("r1_stream_day_totals", """
WITH t AS (SELECT CAST(ts AS TIMESTAMP) AS ts, 1 + user_id % 4 AS q FROM events WHERE event_type = 'purchase')
SELECT CAST(ts AS DATE) AS day, CAST(sum(q) AS BIGINT) AS units, count(*) AS tickets
FROM t GROUP BY 1
HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM t) - INTERVAL 1 DAY""")
def r1_stream_day_totals(spark, sf):
    """R1 + R2: one-day windows closed by the watermark (delay 1 day)."""
    run = scratch_path(spark, f"r1-{uuid.uuid4().hex}")
    q = R.start_day_totals(_ticket_stream(spark, sf), f"{run}/sink", f"{run}/ckpt")
    q.awaitTermination()
    return spark.read.schema("day date, units bigint, tickets bigint").parquet(f"{run}/sink")


@query("r3_stream_running_stock", with_views("""
WITH t AS (SELECT dish_id, quantity AS q FROM ticket_lines),
u AS (SELECT r.ingredient_name, sum(r.quantity_grams * t.q) AS used
      FROM t JOIN menu_recipe_items r ON r.dish_id = t.dish_id GROUP BY 1)
SELECT i.name, CAST(u.used AS DOUBLE) AS used,
       CAST(greatest(0, i.count - u.used) AS DOUBLE) AS remaining,
       CASE WHEN greatest(0, i.count - u.used) <= 0 THEN 'SIN STOCK'
            WHEN greatest(0, i.count - u.used) < i.min_stock THEN 'BAJO' ELSE 'OK' END AS estado,
       greatest(0, i.count - u.used) <= i.min_stock AS alert
FROM u JOIN ingredient_table i ON i.name = u.ingredient_name""",
                                             "menu_board", "menu_recipe_items", "ingredient_table",
                                             "ticket_lines"))
def r3_stream_running_stock(spark, sf):
    """Running stock per ingredient from the ticket stream (keyed streaming state)."""
    t = Tables.of(spark, sf)
    run = scratch_path(spark, f"r3-{uuid.uuid4().hex}")
    q = R.running_stock(_ticket_stream(spark, sf), t.items, t.ing, f"{run}/sink", f"{run}/ckpt")
    q.awaitTermination()
    return R.current_stock(spark, f"{run}/sink")


@query("r3_stock_ledger_stream", with_views(f"""
WITH RECURSIVE {REPLAY_SQL}, {LASTING_SQL}
SELECT {LEDGER_COLUMNS} FROM ledger WHERE epoch_ms(ts) < {UNTIL_SQL}
UNION ALL
SELECT name, epoch_us(due), NULL, 'alert', NULL, NULL,
       CAST((SELECT max_by(after, k) FROM replay r JOIN moves m USING (name, k) WHERE r.name = l.name AND m.ts <= l.due) AS DOUBLE),
       CASE WHEN (SELECT max_by(after, k) FROM replay r JOIN moves m USING (name, k) WHERE r.name = l.name AND m.ts <= l.due) <= 0
            THEN 'SIN STOCK' ELSE 'BAJO' END
FROM lasting l WHERE epoch_us(due) < {UNTIL_SQL} * 1000""", "stock_events", *MOVE_VIEWS))
def r3_stock_ledger_stream(spark, sf):
    """R3 with deliveries and stock-takes: the stateful processor's ledger up to its watermark,
    and its timers' alerts."""
    t = Tables.of(spark, sf)
    run = scratch_path(spark, f"r3-ledger-{uuid.uuid4().hex}")
    moves = M.event_moves(A.stock_events(_event_stream(spark, sf), _parts(spark, sf)), t.items)
    L.start_ledger(moves, t.ing, f"{run}/sink", f"{run}/ckpt").awaitTermination()
    return ledger_report(L.read_ledger(spark, f"{run}/sink"))
