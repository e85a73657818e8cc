"""Registered demand queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from mise.operators import demand as D
from mise.plans.oracle_views import with_views
from mise.plans.registry import AS_OF, Tables, query

SINCE_30 = (_dt.date.fromisoformat(AS_OF) - _dt.timedelta(days=30)).isoformat()
KEY_SQL = "coalesce(nullif(r.menu_item_id, 0), r.dish_id)"

STOCK_DEMAND_SQL = """SELECT ingredient_name, sum(quantity_grams) AS needed
FROM menu_recipe_items GROUP BY ingredient_name"""

PROJ_DEMAND_SQL = f"""SELECT r.ingredient_name, sum(r.quantity_grams * p.projected_units) AS needed
FROM menu_recipe_items r JOIN projection_rows p ON p.dish_id = {KEY_SQL} AND p.is_active
GROUP BY r.ingredient_name"""

SALES_DEMAND_SQL = f"""SELECT r.ingredient_name, sum(r.quantity_grams * u.units) AS needed
FROM menu_recipe_items r JOIN (
  SELECT dish_id, sum(quantity) AS units FROM sale_items
  WHERE sale_id IN (SELECT id FROM daily_sales WHERE created_at >= TIMESTAMP '{SINCE_30} 00:00:00')
  GROUP BY dish_id) u ON u.dish_id = {KEY_SQL}
GROUP BY r.ingredient_name"""


def _demand_body(demand_sql: str) -> str:
    return f"""SELECT ingredient_name, CAST(needed AS DOUBLE) AS needed FROM ({demand_sql}) d"""


@query("a15_demand_stock", with_views(_demand_body(STOCK_DEMAND_SQL), "menu_recipe_items"))
def a15_demand_stock(spark, sf):
    d = D.demand_from_stock(Tables.of(spark, sf).items)
    return d.select("ingredient_name", F.col("needed").cast("double").alias("needed"))


def _sales_demand(t: Tables, all_inactive: bool = False):
    proj = t.proj_rows
    if all_inactive:
        proj = proj.withColumn("is_active", F.lit(False))
    return D.demand_from_sales(t.items, proj, t.sales, t.sale_items, SINCE_30)


@query("a15_demand_projections", with_views(_demand_body(PROJ_DEMAND_SQL),
                                            "menu_recipe_items", "projection_rows"))
def a15_demand_projections(spark, sf):
    d = _sales_demand(Tables.of(spark, sf))
    return d.select("ingredient_name", F.col("needed").cast("double").alias("needed"))


@query("a15_demand_sales_history", with_views(_demand_body(SALES_DEMAND_SQL),
                                              "menu_recipe_items", "daily_sales", "sale_items"))
def a15_demand_sales_history(spark, sf):
    d = _sales_demand(Tables.of(spark, sf), all_inactive=True)
    return d.select("ingredient_name", F.col("needed").cast("double").alias("needed"))


def _shopping_sql(demand_sql: str) -> str:
    """The oracle replays the reference's two loops: demanded names first, then the
    remaining ingredients under their minimum."""
    return f"""
WITH d AS ({demand_sql}),
ing AS (SELECT *, coalesce(count, 0) AS st, coalesce(min_stock, 0) AS mn FROM ingredient_table),
l1 AS (SELECT i.*, CASE WHEN i.st < i.mn THEN greatest(greatest(0, d.needed - i.st), i.mn - i.st)
                        ELSE greatest(0, d.needed - i.st) END AS short,
              CASE WHEN d.needed > i.st THEN 'menu_needed' ELSE 'min_stock' END AS reason
       FROM d JOIN ing i ON i.name = d.ingredient_name
       WHERE NOT (greatest(0, d.needed - i.st) <= 0 AND i.st >= i.mn)),
l2 AS (SELECT i.*, i.mn - i.st AS short, 'min_stock' AS reason FROM ing i
       WHERE i.name NOT IN (SELECT name FROM l1) AND i.st < i.mn AND i.mn - i.st > 0),
u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
q AS (SELECT u.*, CAST(CASE WHEN measure IN ('kg', 'l') THEN round(short * 0.001, 2)
                            WHEN measure = 'lb' THEN round(CAST(short AS DOUBLE) / 453.592, 2)
                            ELSE round(short, 0) END AS DECIMAL(20,2)) AS dq
      FROM u)
SELECT name, CAST(dq AS DOUBLE) AS qty, measure, CAST(coalesce(cost, 0) AS DOUBLE) AS cost,
       CASE WHEN supplier IS NULL OR supplier = '' THEN 'Sin proveedor' ELSE supplier END AS supplier,
       coalesce(brand, '') AS brand, coalesce(presentation, '') AS presentation,
       coalesce(classification, '') AS classification, reason,
       CASE WHEN measure = 'lb' THEN round(CAST(st AS DOUBLE) / 453.592, 2)
            ELSE CAST(round(st * 0.001, 3) AS DOUBLE) END AS current_stock,
       CASE WHEN measure = 'lb' THEN round(CAST(mn AS DOUBLE) / 453.592, 2)
            ELSE CAST(round(mn * 0.001, 3) AS DOUBLE) END AS min_stock,
       CASE measure WHEN 'g' THEN 'kg' WHEN 'ml' THEN 'l' ELSE measure END AS stock_measure,
       dq * coalesce(cost, 0) AS item_cost
FROM q"""


def _list_cols(sql: str) -> str:
    return f"SELECT * EXCLUDE (item_cost) FROM ({sql}) s ORDER BY name"


def _total(sql: str) -> str:
    return f"""SELECT CAST(round(coalesce(sum(item_cost), 0), 2) AS DOUBLE) AS total_cost,
       count(*) AS items FROM ({sql}) s"""


@query("a16_shopping_list_stock", with_views(_list_cols(_shopping_sql(STOCK_DEMAND_SQL)),
                                             "ingredient_table", "menu_recipe_items"))
def a16_shopping_list_stock(spark, sf):
    t = Tables.of(spark, sf)
    return D.shopping_list(t.ing, D.demand_from_stock(t.items)).drop("item_cost_dec")


@query("a16_shopping_total_stock", with_views(_total(_shopping_sql(STOCK_DEMAND_SQL)),
                                              "ingredient_table", "menu_recipe_items"))
def a16_shopping_total_stock(spark, sf):
    t = Tables.of(spark, sf)
    return D.shopping_total(D.shopping_list(t.ing, D.demand_from_stock(t.items)))


@query("a16_shopping_list_projections", with_views(_list_cols(_shopping_sql(PROJ_DEMAND_SQL)),
                                                   "ingredient_table", "menu_recipe_items",
                                                   "projection_rows"))
def a16_shopping_list_projections(spark, sf):
    t = Tables.of(spark, sf)
    return D.shopping_list(t.ing, _sales_demand(t)).drop("item_cost_dec")


@query("a16_shopping_total_sales_history", with_views(_total(_shopping_sql(SALES_DEMAND_SQL)),
                                                      "ingredient_table", "menu_recipe_items",
                                                      "daily_sales", "sale_items"))
def a16_shopping_total_sales_history(spark, sf):
    t = Tables.of(spark, sf)
    return D.shopping_total(D.shopping_list(t.ing, _sales_demand(t, all_inactive=True)))


@query("a17_purchase_order", with_views(f"""
SELECT supplier, name, CAST(GROUPING(supplier, name) AS BIGINT) AS level, count(*) AS articles,
       CAST(round(sum(CAST(qty AS DECIMAL(20,2)) * CAST(cost AS DECIMAL(12,2))), 2) AS DOUBLE) AS amount,
       count(DISTINCT supplier) AS suppliers
FROM ({_shopping_sql(STOCK_DEMAND_SQL)}) s
GROUP BY ROLLUP (supplier, name)""", "ingredient_table", "menu_recipe_items"))
def a17_purchase_order(spark, sf):
    t = Tables.of(spark, sf)
    shop = D.shopping_list(t.ing, D.demand_from_stock(t.items))
    return D.purchase_order(shop.select("name", "supplier", "qty", "cost"))
