"""Registered projection and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mise.operators import projections as P
from mise.operators.sales import daily_units
from mise.plans.oracle_views import with_views
from mise.plans.q_costing import UNIT_COST_SQL
from mise.plans.q_sales import HISTORY_START
from mise.plans.registry import AS_OF, Tables, query

COST_INFO_SQL = f"""
SELECT coalesce(nullif(r.menu_item_id, 0), r.dish_id) AS dish_id,
       round(sum(r.quantity_grams * {UNIT_COST_SQL}), 2) AS uc, sum(r.quantity_grams) AS g
FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name
GROUP BY 1"""

PROJ_SQL = f"""
SELECT p.*, CAST(coalesce(c.uc, 0) AS DOUBLE) AS unit_cost,
       CAST(round(coalesce(c.g, 0) * p.projected_units, 2) AS DOUBLE) AS estimated_qty,
       CAST(round(coalesce(c.uc, 0) * p.projected_units, 2) AS DOUBLE) AS estimated_cost
FROM projection_rows p LEFT JOIN ({COST_INFO_SQL}) c ON c.dish_id = p.dish_id"""

VIEWS = ("projection_rows", "menu_recipe_items", "ingredient_table")


@query("a18_init_projections", with_views(f"""
SELECT m.id AS dish_id, m.dish_name, 30 AS projected_units,
       CAST(coalesce(c.uc, 0) AS DOUBLE) AS unit_cost,
       CAST(round(coalesce(c.g, 0) * 30, 2) AS DOUBLE) AS estimated_qty,
       CAST(round(coalesce(c.uc, 0) * 30, 2) AS DOUBLE) AS estimated_cost,
       DATE '{AS_OF}' AS start_date,
       CAST(date_trunc('month', DATE '{AS_OF}') + INTERVAL 1 MONTH AS DATE) AS end_date
FROM menu_board m LEFT JOIN ({COST_INFO_SQL}) c ON c.dish_id = m.id""",
                                          "menu_board", "menu_recipe_items", "ingredient_table"))
def a18_init_projections(spark, sf):
    t = Tables.of(spark, sf)
    return P.init_projections(t.menu, t.items, t.ing, AS_OF)


@query("p23_thirty_day_projections", with_views(f"""
SELECT id AS dish_id, dish_name, DATE '{AS_OF}' AS start_date, DATE '{AS_OF}' + 30 AS end_date FROM menu_board""",
                                               "menu_board"))
def p23_thirty_day_projections(spark, sf):
    """P23, the table's default dates: start and 30 days on."""
    from mise.functions.expr import thirty_days_on
    t = Tables.of(spark, sf)
    return P.init_projections(t.menu, t.items, t.ing, AS_OF, thirty_days_on).select(
        "dish_id", "dish_name", "start_date", "end_date")


@query("a19_recost_projections", with_views(PROJ_SQL, *VIEWS))
def a19_recost_projections(spark, sf):
    return Tables.of(spark, sf).proj


@query("a20_projection_totals", with_views(f"""
SELECT count(*) AS dishes, CAST(coalesce(sum(projected_units), 0) AS BIGINT) AS units,
       CAST(round(coalesce(sum(CAST(unit_cost AS DECIMAL(12,2)) * projected_units), 0), 2) AS DOUBLE)
         AS total_cost,
       CAST(round(coalesce(sum(CAST(estimated_qty AS DECIMAL(20,2))), 0) * 0.001, 3) AS DOUBLE) AS total_kg
FROM ({PROJ_SQL}) p""", *VIEWS))
def a20_projection_totals(spark, sf):
    return P.projection_totals(Tables.of(spark, sf).proj)


@query("t4_top_projections", with_views(f"""
SELECT dish_name, CAST(round(projected_units, 0) AS DOUBLE) AS unidades_poyectadas,
       CAST(round(CAST(unit_cost AS DECIMAL(12,2)), 0) AS DOUBLE) AS costo_unitario,
       CAST(round(CAST(unit_cost AS DECIMAL(12,2)) * projected_units, 0) AS DOUBLE) AS costo_total_proyectado
FROM ({PROJ_SQL}) p WHERE is_active ORDER BY projected_units DESC, id LIMIT 20""", *VIEWS))
def t4_top_projections(spark, sf):
    return P.top_projections(Tables.of(spark, sf).proj)


@query("p16_active_projections", with_views(f"""
SELECT id, dish_id, dish_name, projected_units FROM ({PROJ_SQL}) p WHERE is_active""", *VIEWS))
def p16_active_projections(spark, sf):
    return Tables.of(spark, sf).proj.filter(F.col("is_active")).select(
        "id", "dish_id", "dish_name", "projected_units")


@query("j10_projections_view", with_views("""
SELECT p.id, p.dish_id, p.dish_name, p.projected_units, p.is_active, m.category,
       coalesce(c.n, 0) AS ingredient_count
FROM projection_rows p
LEFT JOIN menu_board m ON m.id = p.dish_id
LEFT JOIN (SELECT coalesce(nullif(menu_item_id, 0), dish_id) AS dish_id, count(*) AS n
           FROM menu_recipe_items GROUP BY 1) c ON c.dish_id = p.dish_id""",
                                          "projection_rows", "menu_board", "menu_recipe_items"))
def j10_projections_view(spark, sf):
    t = Tables.of(spark, sf)
    return P.projections_view(t.proj_rows, t.menu, t.items)


FORECAST_SQL = f"""
WITH daily AS (SELECT i.dish_id, CAST(s.created_at AS DATE) AS dia, CAST(sum(i.quantity) AS DOUBLE) AS y
               FROM daily_sales s JOIN sale_items i ON s.id = i.sale_id
               WHERE s.created_at >= TIMESTAMP '{HISTORY_START} 00:00:00' GROUP BY 1, 2),
d AS (SELECT dish_id, dia, y, CAST(dia - min(dia) OVER (PARTITION BY dish_id) AS DOUBLE) AS t FROM daily),
st AS (SELECT dish_id, regr_slope(y, t) AS s, regr_intercept(y, t) AS i, count(*) AS n, avg(y) AS m,
              max(dia) AS d1, max(t) AS t1 FROM d GROUP BY dish_id),
e AS (SELECT d.dish_id, dayofweek(d.dia) AS wd, avg(d.y - (st.s * d.t + st.i)) AS e
      FROM d JOIN st ON st.dish_id = d.dish_id GROUP BY 1, 2),
fu AS (SELECT dish_id, s, i, t1, d1, unnest(generate_series(1, 30)) AS h FROM st),
pr AS (SELECT fu.dish_id, sum(fu.i + fu.s * (fu.t1 + fu.h) + coalesce(e.e, 0.0)) AS f
       FROM fu LEFT JOIN e ON e.dish_id = fu.dish_id AND e.wd = dayofweek(fu.d1 + CAST(fu.h AS INTEGER))
       GROUP BY 1)
SELECT st.dish_id, st.n AS sales_days,
       CAST(greatest(1, round(CASE WHEN st.n < 3 OR pr.f IS NULL THEN st.m * 30 ELSE pr.f END, 0)) AS INTEGER)
         AS projected_units
FROM st LEFT JOIN pr ON pr.dish_id = st.dish_id"""


def _forecast(t: Tables):
    return P.forecast_units(daily_units(t.sales, t.sale_items, HISTORY_START))


@query("g1_forecast", with_views(FORECAST_SQL, "daily_sales", "sale_items"))
def g1_forecast(spark, sf):
    return _forecast(Tables.of(spark, sf))


@query("g2_apply_forecast", with_views(f"""
SELECT p.id, p.dish_id, p.projected_units AS old_units,
       CAST(coalesce(fc.projected_units, greatest(1, coalesce(p.projected_units, 30))) AS INTEGER)
         AS projected_units,
       fc.projected_units IS NOT NULL AS from_forecast
FROM projection_rows p LEFT JOIN ({FORECAST_SQL}) fc ON fc.dish_id = p.dish_id""",
                                       "projection_rows", "daily_sales", "sale_items"))
def g2_apply_forecast(spark, sf):
    t = Tables.of(spark, sf)
    return P.apply_forecast(t.proj_rows, _forecast(t))


@query("a19_bulk_recost_changes", with_views(f"""
WITH chg AS (SELECT id, dish_id, projected_units + 10 AS projected_units FROM projection_rows WHERE id % 3 = 0)
SELECT p.id, p.dish_id, coalesce(chg.projected_units, p.projected_units) AS projected_units,
       CASE WHEN chg.id IS NOT NULL THEN CAST(coalesce(c.uc, 0) AS DOUBLE) END AS unit_cost,
       CASE WHEN chg.id IS NOT NULL THEN CAST(round(coalesce(c.g, 0) * chg.projected_units, 2) AS DOUBLE) END
         AS estimated_qty,
       CASE WHEN chg.id IS NOT NULL THEN CAST(round(coalesce(c.uc, 0) * chg.projected_units, 2) AS DOUBLE) END
         AS estimated_cost,
       CASE WHEN chg.id IS NOT NULL THEN DATE '{AS_OF}' END AS updated_at
FROM projection_rows p LEFT JOIN chg ON chg.id = p.id LEFT JOIN ({COST_INFO_SQL}) c ON c.dish_id = p.dish_id""",
                                             *VIEWS))
def a19_bulk_recost_changes(spark, sf):
    """A19 bulk: rows whose units changed are re-costed and patched; others untouched."""
    from pyspark.sql import types as T
    t = Tables.of(spark, sf)
    base = t.proj_rows.select("id", "dish_id", "projected_units",
                              *[F.lit(None).cast(T.DoubleType()).alias(c)
                                for c in ("unit_cost", "estimated_qty", "estimated_cost")],
                              F.lit(None).cast("date").alias("updated_at"))
    changes = t.proj_rows.filter(F.col("id") % 3 == 0).select(
        "id", "dish_id", (F.col("projected_units") + 10).alias("projected_units"))
    return P.bulk_recost(base, changes, t.items, t.ing, stamp=F.lit(AS_OF).cast("date"))
