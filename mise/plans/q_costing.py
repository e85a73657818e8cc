"""Registered costing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mise.operators import costing as C
from mise.plans.oracle_views import with_views
from mise.plans.registry import AS_OF, Tables, query

# SQL pieces of the oracle (rule text, DuckDB dialect).
FACTOR_SQL = """(CASE WHEN lower(trim(coalesce({m}, ''))) IN ('g', 'ml', 'u', 'unidad') THEN 1
      WHEN lower(trim(coalesce({m}, ''))) IN ('kg', 'l') THEN 0.001
      WHEN lower(trim(coalesce({m}, ''))) = 'lb' THEN 0.00220462 ELSE 1 END)"""

UNIT_COST_SQL = ("(CASE WHEN r.unit_cost > 0 THEN CAST(r.unit_cost AS DECIMAL(20,10)) "
                 "ELSE coalesce(CAST(i.cost * " + FACTOR_SQL.format(m="i.measure")
                 + " AS DECIMAL(20,10)), 0) END)")

RAW_COST_SQL = f"""
SELECT r.dish_id, round(sum(r.quantity_grams * {UNIT_COST_SQL}), 2) AS raw, count(*) AS n
FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name
GROUP BY r.dish_id"""

COSTING_VIEWS = ("menu_board", "menu_recipe_items", "ingredient_table")


@query("a8_dish_cost", with_views(f"""
SELECT m.id AS dish_id, m.dish_name,
       CAST(coalesce(c.raw, 0) AS DOUBLE) AS raw_cost,
       CAST(m.overhead_cost AS DOUBLE) AS overhead_cost,
       CAST(round(coalesce(c.raw, 0) + m.overhead_cost, 2) AS DOUBLE) AS final_cost,
       coalesce(c.n, 0) AS ingredient_count
FROM menu_board m LEFT JOIN ({RAW_COST_SQL}) c ON c.dish_id = m.id""", *COSTING_VIEWS))
def a8_dish_cost(spark, sf):
    t = Tables.of(spark, sf)
    return C.dish_cost_report(t.menu, t.items, t.ing)


@query("a9_pos_dishes", with_views(f"""
SELECT id, category, dish_name, CAST(sale_price AS DOUBLE) AS sale_price,
       CAST(fin AS DOUBLE) AS cost_total,
       CAST(coalesce(portion_weight_g, 0) AS DOUBLE) AS portion_weight_g,
       CAST(round(sale_price - fin, 2) AS DOUBLE) AS profit,
       CAST(CASE WHEN sale_price = 0 THEN 0 ELSE round((sale_price - fin) / sale_price * 100, 1) END
            AS DOUBLE) AS margin_pct,
       n AS recipe_count
FROM (SELECT m.*, coalesce(c.n, 0) AS n,
             CASE WHEN coalesce(m.cost_total, 0) > 0 THEN m.cost_total
                  ELSE round(coalesce(c.raw, 0) + m.overhead_cost, 2) END AS fin
      FROM menu_board m LEFT JOIN ({RAW_COST_SQL}) c ON c.dish_id = m.id) x""", *COSTING_VIEWS))
def a9_pos_dishes(spark, sf):
    t = Tables.of(spark, sf)
    return C.pos_dishes(t.menu, t.items, t.ing)


@query("a10_recipe_lines", with_views(f"""
SELECT r.id, r.dish_id, r.ingredient_name, CAST(r.quantity_grams AS DOUBLE) AS quantity_grams,
       CAST(round({UNIT_COST_SQL}, 4) AS DOUBLE) AS unit_cost,
       CAST(round(r.quantity_grams * {UNIT_COST_SQL}, 2) AS DOUBLE) AS line_cost
FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name""",
                                   *COSTING_VIEWS))
def a10_recipe_lines(spark, sf):
    t = Tables.of(spark, sf)
    return C.recipe_lines(t.items, t.ing)


@query("a11_dish_nutrition", with_views("""
SELECT m.id AS dish_id, m.dish_name,
       CAST(coalesce(s.protein_g, 0) AS DOUBLE) AS protein_g,
       CAST(coalesce(s.fat_g, 0) AS DOUBLE) AS fat_g,
       CAST(coalesce(s.carbs_g, 0) AS DOUBLE) AS carbs_g,
       CAST(coalesce(s.fiber_g, 0) AS DOUBLE) AS fiber_g,
       CAST(coalesce(s.sodium_mg, 0) AS DOUBLE) AS sodium_mg,
       CAST(coalesce(s.calories, 0) AS DOUBLE) AS calories
FROM menu_board m LEFT JOIN (
  SELECT r.dish_id,
         sum(coalesce(n.protein_g, 0) * r.quantity_grams * 0.01) AS protein_g,
         sum(coalesce(n.fat_g, 0) * r.quantity_grams * 0.01) AS fat_g,
         sum(coalesce(n.carbs_g, 0) * r.quantity_grams * 0.01) AS carbs_g,
         sum(coalesce(n.fiber_g, 0) * r.quantity_grams * 0.01) AS fiber_g,
         sum(coalesce(n.sodium_mg, 0) * r.quantity_grams * 0.01) AS sodium_mg,
         sum(coalesce(n.total_calories, 0) * r.quantity_grams * 0.01) AS calories
  FROM menu_recipe_items r LEFT JOIN nutrition_table n ON n.ingredient_name = r.ingredient_name
  GROUP BY r.dish_id) s ON s.dish_id = m.id""", "menu_board", "menu_recipe_items", "nutrition_table"))
def a11_dish_nutrition(spark, sf):
    t = Tables.of(spark, sf)
    return C.dish_nutrition(t.menu, t.items, t.nut)


@query("a12_recipe_size", with_views("""
SELECT dish_id, CAST(round(sum(quantity_grams), 1) AS DOUBLE) AS total_recipe_g,
       count(*) AS ingredient_count
FROM menu_recipe_items GROUP BY dish_id""", "menu_recipe_items"))
def a12_recipe_size(spark, sf):
    return C.recipe_size(Tables.of(spark, sf).items)


def _recipes(t: Tables):
    """Recipe headers and lines for A13 (the menu and its recipe items)."""
    recipes = t.menu.select(F.col("id").alias("recipe_id"), F.col("dish_name").alias("recipe_name"))
    lines = t.items.select(F.col("dish_id").alias("recipe_id"), "ingredient_name",
                           F.col("quantity_grams").alias("quantity_needed"))
    return recipes, lines


@query("a13_recipe_check", with_views("""
SELECT m.id AS recipe_id, m.dish_name AS recipe_name,
       CAST(coalesce(a.total_cost, 0) AS DOUBLE) AS total_cost,
       CAST(coalesce(a.missing_cost, 0) AS DOUBLE) AS missing_cost,
       coalesce(a.lines, 0) AS lines,
       coalesce(a.missing_lines, 0) AS missing_lines,
       coalesce(a.unknown_ingredients, 0) AS unknown_ingredients,
       coalesce(a.missing_lines, 0) = 0 AS all_available
FROM menu_board m LEFT JOIN (
  SELECT r.dish_id,
         round(sum(r.quantity_grams * coalesce(i.cost, 0)), 2) AS total_cost,
         round(sum(CASE WHEN r.quantity_grams > coalesce(i.count, 0)
                        THEN r.quantity_grams - coalesce(i.count, 0) ELSE 0 END * coalesce(i.cost, 0)), 2)
           AS missing_cost,
         count(*) AS lines,
         count(*) FILTER (WHERE r.quantity_grams > coalesce(i.count, 0)) AS missing_lines,
         count(*) FILTER (WHERE i.name IS NULL) AS unknown_ingredients
  FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name
  GROUP BY r.dish_id) a ON a.dish_id = m.id""", *COSTING_VIEWS))
def a13_recipe_check(spark, sf):
    t = Tables.of(spark, sf)
    recipes, lines = _recipes(t)
    return C.check_recipes(recipes, lines, t.ing)


@query("a13_shopping_lines", with_views("""
SELECT r.dish_id AS recipe_id, r.ingredient_name AS name,
       CAST(r.quantity_grams - coalesce(i.count, 0) AS DOUBLE) AS qty, i.measure,
       CAST((r.quantity_grams - coalesce(i.count, 0)) * coalesce(i.cost, 0) AS DOUBLE) AS cost
FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name
WHERE r.quantity_grams > coalesce(i.count, 0)""", *COSTING_VIEWS))
def a13_shopping_lines(spark, sf):
    t = Tables.of(spark, sf)
    return C.recipe_shopping_lines(_recipes(t)[1], t.ing)


@query("a14_have_need_pct", with_views("""
SELECT r.dish_id AS recipe_id, r.ingredient_name,
       CAST(r.quantity_grams AS DOUBLE) AS needed,
       CAST(coalesce(i.count, 0) AS DOUBLE) AS have,
       CAST(greatest(0, r.quantity_grams - coalesce(i.count, 0)) AS DOUBLE) AS missing,
       CAST(round(least(greatest(coalesce(i.count, 0), 0) * 100 / r.quantity_grams, 100), 1) AS DOUBLE)
         AS have_pct
FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name""",
                                    *COSTING_VIEWS))
def a14_have_need_pct(spark, sf):
    t = Tables.of(spark, sf)
    _, lines = _recipes(t)
    return C.recipe_check_lines(lines, t.ing)


@query("j7_recipes_with_items", with_views("""
SELECT m.id AS recipe_id, m.dish_name AS recipe_name, coalesce(x.n, 0) AS n_ingredients,
       x.first_name AS first_ingredient, x.last_name AS last_ingredient,
       CAST(coalesce(x.chars, 0) AS BIGINT) AS name_chars, coalesce(x.unknown, 0) AS unknown_ingredients
FROM menu_board m LEFT JOIN (
  SELECT r.dish_id, count(*) AS n, min(r.ingredient_name) AS first_name, max(r.ingredient_name) AS last_name,
         sum(length(r.ingredient_name)) AS chars, count(*) FILTER (WHERE i.name IS NULL) AS unknown
  FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name
  GROUP BY r.dish_id) x ON x.dish_id = m.id""", *COSTING_VIEWS))
def j7_recipes_with_items(spark, sf):
    """J6/J7 summary per recipe: line count, first/last ingredient, unknown ingredients.
    Bounded aggregates only; the nested list itself is ``costing.recipes_with_items``."""
    t = Tables.of(spark, sf)
    recipes, lines = _recipes(t)
    return C.recipe_summary(recipes, lines, t.ing)


@query("j7_nested_list", with_views("""
SELECT m.id AS recipe_id, m.dish_name AS recipe_name, coalesce(x.n, 0) AS n_ingredients,
       coalesce(x.items, '') AS ingredients
FROM menu_board m LEFT JOIN (
  SELECT r.dish_id, count(*) AS n,
         string_agg(r.ingredient_name || ':' || CAST(CAST(r.quantity_grams AS INTEGER) AS VARCHAR), '|'
                    ORDER BY r.ingredient_name, r.quantity_grams) AS items
  FROM menu_recipe_items r GROUP BY r.dish_id) x ON x.dish_id = m.id""", *COSTING_VIEWS))
def j7_nested_list(spark, sf):
    """Each recipe with its whole ingredient list (nested, shown as name:grams)."""
    t = Tables.of(spark, sf)
    nested = C.recipes_with_items(*_recipes(t), t.ing)
    shown = F.transform("ingredients", lambda x: F.concat(
        x["ingredient_name"], F.lit(":"), x["quantity_needed"].cast("int").cast("string")))
    return nested.select("recipe_id", "recipe_name", "n_ingredients",
                         F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("ingredients"))


@query("a29_dish_stock_flags", with_views("""
SELECT m.id AS dish_id, m.dish_name, coalesce(f.low, false) AS low_stock,
       coalesce(f.n, 0) AS short_ingredients
FROM menu_board m LEFT JOIN (
  SELECT r.dish_id, bool_or(coalesce(i.count, 0) < r.quantity_grams) AS low,
         count(*) FILTER (WHERE coalesce(i.count, 0) < r.quantity_grams) AS n
  FROM menu_recipe_items r LEFT JOIN ingredient_table i ON i.name = r.ingredient_name
  GROUP BY r.dish_id) f ON f.dish_id = m.id""", *COSTING_VIEWS))
def a29_dish_stock_flags(spark, sf):
    t = Tables.of(spark, sf)
    return C.dish_stock_flags(t.menu, t.items, t.ing)


PROFIT_SQL = f"""
SELECT m.id AS recipe_id, coalesce(m.dish_name, 'Sin nombre') AS recipe_name,
       CAST(coalesce(c.raw, 0) AS DOUBLE) AS cost, coalesce(c.n, 0) AS ingredient_count,
       CAST(coalesce(m.sale_price, 0) AS DOUBLE) AS sale_price,
       CAST(coalesce(u.units, 0) AS BIGINT) AS units_sold
FROM menu_board m
LEFT JOIN ({RAW_COST_SQL}) c ON c.dish_id = m.id
LEFT JOIN (SELECT si.dish_id, sum(si.quantity) AS units FROM sale_items si
           WHERE si.sale_id IN (SELECT id FROM daily_sales
                                WHERE created_at >= date_trunc('month', DATE '{AS_OF}'))
           GROUP BY si.dish_id) u ON u.dish_id = m.id"""


@query("a31_profitability", with_views(PROFIT_SQL, *COSTING_VIEWS, "sale_items", "daily_sales"))
def a31_profitability(spark, sf):
    t = Tables.of(spark, sf)
    since = F.trunc(F.lit(AS_OF).cast("date"), "month")
    return C.profitability(t.menu, t.items, t.ing, t.sales, t.sale_items, since)


@query("t5_top_recipes_by_cost", with_views(
    "SELECT * FROM (" + PROFIT_SQL + ") p ORDER BY cost DESC, recipe_id LIMIT 8",
    *COSTING_VIEWS, "sale_items", "daily_sales"))
def t5_top_recipes_by_cost(spark, sf):
    return a31_profitability(spark, sf).orderBy(F.desc("cost"), "recipe_id").limit(8)


@query("p18_margin_band", with_views(f"""
SELECT id AS dish_id, dish_name, CAST(margin AS DOUBLE) AS margin_pct,
       CASE WHEN margin >= 50 THEN 'high' WHEN margin >= 20 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT m.id, m.dish_name,
             CASE WHEN m.sale_price = 0 THEN 0.0
                  ELSE round((m.sale_price - round(coalesce(c.raw, 0) + m.overhead_cost, 2)) / m.sale_price * 100, 1)
             END AS margin
      FROM menu_board m LEFT JOIN ({RAW_COST_SQL}) c ON c.dish_id = m.id) x""", *COSTING_VIEWS))
def p18_margin_band(spark, sf):
    """P17 + P18 on the recomputed dish cost: margin (0 when the price is 0) and band."""
    from mise.functions.expr import margin_band
    t = Tables.of(spark, sf)
    c = C.dish_cost_report(t.menu, t.items, t.ing)
    m = t.menu.select(F.col("id").alias("dish_id"), "sale_price")
    j = c.join(m, "dish_id")
    price = F.col("sale_price").cast("double")
    margin = F.when(F.col("sale_price") == 0, F.lit(0.0)).otherwise(
        F.round((F.col("sale_price") - F.col("final_cost").cast("decimal(12,2)")).cast("double") / price * 100, 1))
    return j.select("dish_id", "dish_name", margin.alias("margin_pct"), margin_band(margin).alias("band"))


@query("p19_suggested_prices", with_views(f"""
SELECT recipe_id, cost, CAST(round(CAST(cost AS DECIMAL(20,2)) * 2, 2) AS DOUBLE) AS price_2x,
       CAST(round(CAST(cost AS DECIMAL(20,2)) * 3, 2) AS DOUBLE) AS price_3x
FROM ({PROFIT_SQL}) p""", *COSTING_VIEWS, "sale_items", "daily_sales"))
def p19_suggested_prices(spark, sf):
    """Suggested prices at 2x and 3x the raw recipe cost."""
    p = a31_profitability(spark, sf)
    c = F.col("cost").cast("decimal(20,2)")
    return p.select("recipe_id", "cost", F.round(c * 2, 2).cast("double").alias("price_2x"),
                    F.round(c * 3, 2).cast("double").alias("price_3x"))


@query("a9_persist_costs", with_views(f"""
SELECT m.id, m.dish_name, CAST(round(coalesce(c.raw, 0) + m.overhead_cost, 2) AS DOUBLE) AS cost_total,
       DATE '{AS_OF}' AS updated_at
FROM menu_board m LEFT JOIN ({RAW_COST_SQL}) c ON c.dish_id = m.id""", *COSTING_VIEWS))
def a9_persist_costs(spark, sf):
    """A9 persisted: the final cost patched onto every dish's cost_total (M2)."""
    from mise.operators.mutations import patch
    t = Tables.of(spark, sf)
    costs = C.dish_cost_report(t.menu, t.items, t.ing).select(
        F.col("dish_id").alias("id"), F.col("final_cost").cast("decimal(10,2)").alias("cost_total"))
    out = patch(t.menu, costs, ["id"], ["cost_total"], order=None, stamp_col="updated_at",
                stamp=F.lit(AS_OF).cast("date"))
    return out.select("id", "dish_name", F.col("cost_total").cast("double").alias("cost_total"), "updated_at")
