"""Registered sales and ticket queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from mise.operators import sales as S
from mise.operators import stock_moves as M
from mise.plans.oracle_views import with_views
from mise.plans.q_costing import UNIT_COST_SQL
from mise.plans.registry import AS_OF, Tables, query

HISTORY_START = "1995-01-01"  # the whole sales history of the fixture
LAST_30 = (_dt.date.fromisoformat(AS_OF) - _dt.timedelta(days=30)).isoformat()


@query("a4_daily_sales_report", with_views("""
SELECT CAST(created_at AS DATE) AS dia, CAST(round(sum(total_sale), 0) AS DOUBLE) AS ventas,
       CAST(round(sum(total_cost), 0) AS DOUBLE) AS costos,
       CAST(round(sum(total_profit), 0) AS DOUBLE) AS ganancia
FROM daily_sales GROUP BY 1""", "daily_sales"))
def a4_daily_sales_report(spark, sf):
    return S.daily_rollup(Tables.of(spark, sf).sales)


@query("a4_daily_sales_dashboard", with_views("""
SELECT CAST(created_at AS DATE) AS fecha, CAST(round(sum(total_sale), 0) AS DOUBLE) AS ventas,
       CAST(round(sum(total_cost), 0) AS DOUBLE) AS costos,
       CAST(round(sum(total_profit), 0) AS DOUBLE) AS ganancia
FROM daily_sales GROUP BY 1 ORDER BY fecha DESC LIMIT 30""", "daily_sales"))
def a4_daily_sales_dashboard(spark, sf):
    return S.daily_rollup_newest(Tables.of(spark, sf).sales)


@query("a4_daily_sales_api", with_views("""
SELECT * FROM (
  SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS fecha,
         CAST(round(sum(total_sale), 0) AS DOUBLE) AS ventas,
         CAST(round(sum(total_cost), 0) AS DOUBLE) AS costos,
         CAST(round(sum(total_profit), 0) AS DOUBLE) AS ganancia
  FROM daily_sales GROUP BY 1 ORDER BY fecha DESC LIMIT 30) t ORDER BY fecha""", "daily_sales"))
def a4_daily_sales_api(spark, sf):
    return S.daily_rollup_api(Tables.of(spark, sf).sales)


@query("a5_day_summary", with_views(f"""
SELECT CAST(coalesce(sum(total_sale), 0) AS DOUBLE) AS total_sale,
       CAST(coalesce(sum(total_cost), 0) AS DOUBLE) AS total_cost,
       CAST(coalesce(sum(total_profit), 0) AS DOUBLE) AS total_profit,
       count(*) AS orders_count, CAST(coalesce(sum(items_count), 0) AS BIGINT) AS items_count
FROM daily_sales WHERE created_at >= TIMESTAMP '{AS_OF} 00:00:00'""", "daily_sales"))
def a5_day_summary(spark, sf):
    return S.day_summary(Tables.of(spark, sf).sales, AS_OF)


@query("a6_daily_units", with_views(f"""
SELECT i.dish_id, CAST(s.created_at AS DATE) AS dia, CAST(sum(i.quantity) AS BIGINT) AS unidades
FROM daily_sales s JOIN sale_items i ON s.id = i.sale_id
WHERE s.created_at >= TIMESTAMP '{HISTORY_START} 00:00:00'
GROUP BY 1, 2""", "daily_sales", "sale_items"))
def a6_daily_units(spark, sf):
    t = Tables.of(spark, sf)
    return S.daily_units(t.sales, t.sale_items, HISTORY_START)


@query("a7_units_last_30_days", with_views(f"""
SELECT dish_id, CAST(sum(quantity) AS BIGINT) AS units FROM sale_items
WHERE sale_id IN (SELECT id FROM daily_sales WHERE created_at >= TIMESTAMP '{LAST_30} 00:00:00')
GROUP BY dish_id""", "daily_sales", "sale_items"))
def a7_units_last_30_days(spark, sf):
    t = Tables.of(spark, sf)
    return S.units_by_dish(t.sales, t.sale_items, LAST_30)


@query("a7_units_month_to_date", with_views(f"""
SELECT dish_id, CAST(sum(quantity) AS BIGINT) AS units FROM sale_items
WHERE sale_id IN (SELECT id FROM daily_sales
                  WHERE created_at >= CAST(date_trunc('month', DATE '{AS_OF}') AS TIMESTAMP))
GROUP BY dish_id""", "daily_sales", "sale_items"))
def a7_units_month_to_date(spark, sf):
    t = Tables.of(spark, sf)
    return S.units_by_dish(t.sales, t.sale_items, F.trunc(F.lit(AS_OF).cast("date"), "month"))


@query("p21_daily_profit_sign", with_views("""
SELECT CAST(created_at AS DATE) AS dia, CAST(sum(total_profit) AS DOUBLE) AS profit,
       CASE WHEN sum(total_profit) >= 0 THEN 'positive' ELSE 'negative' END AS sign
FROM daily_sales GROUP BY 1""", "daily_sales"))
def p21_daily_profit_sign(spark, sf):
    return S.daily_profit_flags(Tables.of(spark, sf).sales)


DISH_COST_SQL = f"""
SELECT m.id AS dish_id, m.dish_name, m.sale_price,
       CAST(round(coalesce(r.raw, 0) + m.overhead_cost, 2) AS DECIMAL(12,2)) AS cpu
FROM menu_board m LEFT JOIN (
  SELECT r.dish_id, sum(r.quantity_grams * {UNIT_COST_SQL}) AS raw
  FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name
  GROUP BY r.dish_id) r ON r.dish_id = m.id"""

PRICED_SQL = f"""
SELECT t.ticket_id, t.line_id, t.dish_id, d.dish_name, t.quantity,
       d.dish_name IS NOT NULL AS dish_found,
       CAST(coalesce(d.sale_price, 0) AS DOUBLE) AS sale_price_unit,
       CAST(d.cpu AS DOUBLE) AS cost_per_unit,
       CAST(round(coalesce(d.sale_price, 0) * t.quantity, 2) AS DOUBLE) AS line_sale,
       CAST(round(d.cpu * t.quantity, 2) AS DOUBLE) AS line_cost,
       CAST(round(round(coalesce(d.sale_price, 0) * t.quantity, 2) - round(d.cpu * t.quantity, 2), 2)
            AS DOUBLE) AS line_profit
FROM ticket_lines_multi t LEFT JOIN ({DISH_COST_SQL}) d ON d.dish_id = t.dish_id
WHERE t.quantity >= 1"""

TICKET_VIEWS = ("ticket_lines_multi", "menu_board", "menu_recipe_items", "ingredient_table")


def _priced(t: Tables):
    return S.price_tickets(t.tickets_multi, t.menu, t.items, t.ing)


@query("a26_ticket_lines", with_views(PRICED_SQL, *TICKET_VIEWS))
def a26_ticket_lines(spark, sf):
    return _priced(Tables.of(spark, sf)).drop("ts")


TOTALS_SQL = f"""
SELECT ticket_id, bool_and(dish_found) AND count(*) > 0 AS accepted,
       CAST(round(sum(CAST(line_sale AS DECIMAL(12,2))), 2) AS DOUBLE) AS total_sale,
       CAST(round(sum(CAST(line_cost AS DECIMAL(12,2))), 2) AS DOUBLE) AS total_cost,
       CAST(round(sum(CAST(line_profit AS DECIMAL(12,2))), 2) AS DOUBLE) AS total_profit,
       CAST(sum(quantity) AS INTEGER) AS items_count
FROM ({PRICED_SQL}) p GROUP BY ticket_id"""


@query("a27_ticket_totals", with_views(TOTALS_SQL, *TICKET_VIEWS))
def a27_ticket_totals(spark, sf):
    return S.post_sales(_priced(Tables.of(spark, sf))).drop("created_at")


@query("a28_stock_depletion", with_views(f"""
WITH tot AS ({TOTALS_SQL}),
     units AS (SELECT t.dish_id, sum(t.quantity) AS units FROM ticket_lines_multi t
               WHERE t.quantity >= 1 AND t.ticket_id IN (SELECT ticket_id FROM tot WHERE accepted)
               GROUP BY t.dish_id),
     used AS (SELECT r.ingredient_name, sum(r.quantity_grams * u.units) AS used
              FROM menu_recipe_items r JOIN units u ON u.dish_id = r.dish_id GROUP BY 1)
SELECT i.name, CAST(i.count AS DOUBLE) AS count_before, CAST(coalesce(u.used, 0) AS DOUBLE) AS depleted,
       CAST(CASE WHEN u.used IS NULL THEN i.count
                 WHEN i.count - u.used > 0 THEN i.count - u.used ELSE 0 END AS DOUBLE) AS count_after
FROM ingredient_table i LEFT JOIN used u ON u.ingredient_name = i.name""", *TICKET_VIEWS))
def a28_stock_depletion(spark, sf):
    t = Tables.of(spark, sf)
    _priced_lines, _totals, stock = S.post_tickets(t.tickets_multi, t.menu, t.items, t.ing)
    return stock


#: Every move of an ingredient replayed one after the other.
REPLAY_SQL = """moves AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, seq, rank) AS k FROM stock_moves),
replay AS (
  SELECT name, CAST(0 AS BIGINT) AS k, CAST(count AS DECIMAL(18,2)) AS before, CAST(count AS DECIMAL(18,2)) AS after
  FROM ingredient_table
  UNION ALL
  SELECT m.name, m.k, r.after, CAST(CASE m.kind WHEN 'count' THEN m.amount WHEN 'delivery' THEN r.after + m.amount
    ELSE greatest(0, r.after - m.amount) END AS DECIMAL(18,2))
  FROM replay r JOIN moves m ON m.name = r.name AND m.k = r.k + 1),
ledger AS (
  SELECT m.name, m.ts, m.seq, m.kind, m.rank, m.amount, r.before, r.after, i.min_stock,
         CASE WHEN r.before > i.min_stock AND r.after <= i.min_stock
              THEN CASE WHEN r.after <= 0 THEN 'SIN STOCK' ELSE 'BAJO' END END AS alert
  FROM replay r JOIN moves m ON m.name = r.name AND m.k = r.k JOIN ingredient_table i ON i.name = r.name)"""
MOVE_VIEWS = ("stock_moves", "ingredient_table")
#: Where the stream's watermark ends: a day (in whole milliseconds) before the last event.
UNTIL_SQL = "(SELECT epoch_ms(max(ts)) - 86400000 FROM stock_events)"
LASTING_SQL = """lasting AS (
  SELECT name, due, low_since FROM (
    SELECT name, ts + INTERVAL 1 DAY AS due, ts AS low_since, alert,
           lead(ts) OVER (PARTITION BY name ORDER BY ts, seq, rank) AS lifted
    FROM ledger WHERE (before <= min_stock) <> (after <= min_stock)) t
  WHERE alert IS NOT NULL AND (lifted IS NULL OR lifted > due))"""


@query("a28_stock_with_deliveries", with_views(f"""
WITH RECURSIVE {REPLAY_SQL},
last AS (SELECT name, max_by(after, k) AS after FROM replay GROUP BY name),
sums AS (SELECT name, sum(amount) FILTER (WHERE kind = 'sale') AS sale,
                sum(amount) FILTER (WHERE kind = 'delivery') AS delivery FROM moves GROUP BY name)
SELECT i.name, CAST(i.count AS DOUBLE) AS count_before, CAST(coalesce(s.sale, 0) AS DOUBLE) AS sold,
       CAST(coalesce(s.delivery, 0) AS DOUBLE) AS delivered, CAST(l.after AS DOUBLE) AS count_after,
       CASE WHEN l.after <= 0 THEN 'SIN STOCK' WHEN l.after < i.min_stock THEN 'BAJO' ELSE 'OK' END AS estado
FROM ingredient_table i JOIN last l ON l.name = i.name LEFT JOIN sums s ON s.name = i.name""", *MOVE_VIEWS))
def a28_stock_with_deliveries(spark, sf):
    t = Tables.of(spark, sf)
    return M.stock_after_moves(t.ing, t.stock_moves)


LEDGER_COLUMNS = """name, epoch_us(ts) AS ts_us, seq, kind, CAST(amount AS DOUBLE) AS amount, CAST(before AS DOUBLE) AS before,
       CAST(after AS DOUBLE) AS after, alert"""


def ledger_report(ledger):
    number = lambda c: F.col(c).cast("double").alias(c)
    return ledger.select("name", F.unix_micros("ts").alias("ts_us"), "seq", "kind", number("amount"), number("before"),
                         number("after"), "alert")


@query("a28_stock_ledger", with_views(f"WITH RECURSIVE {REPLAY_SQL} SELECT {LEDGER_COLUMNS} FROM ledger", *MOVE_VIEWS))
def a28_stock_ledger(spark, sf):
    t = Tables.of(spark, sf)
    return ledger_report(M.stock_ledger(t.ing, t.stock_moves))


@query("a28_lasting_alerts", with_views(f"""
WITH RECURSIVE {REPLAY_SQL}, {LASTING_SQL}
SELECT name, epoch_us(due) AS due_us, epoch_us(low_since) AS low_since_us FROM lasting WHERE epoch_us(due) < {UNTIL_SQL} * 1000""",
                                        "stock_events", *MOVE_VIEWS))
def a28_lasting_alerts(spark, sf):
    t = Tables.of(spark, sf)
    last = t.raw("events").filter(F.col("event_type").isin("purchase", "signup", "error")).select(
        F.timestamp_millis(F.unix_millis(F.max("ts").cast("timestamp")) - 86_400_000)).scalar()
    return M.lasting_alerts(M.stock_ledger(t.ing, t.stock_moves), "1 DAY", last).select(
        "name", F.unix_micros("ts").alias("due_us"), F.unix_micros("low_since").alias("low_since_us"))
