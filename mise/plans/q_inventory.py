"""Registered inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mise.functions.expr import normalise_class
from mise.operators import inventory as I
from mise.plans.oracle_views import with_views
from mise.plans.registry import AS_OF, Tables, decimals_as_double, query
from mise.sources.sinks import inventory_export_frame

ING = "ingredient_table"


@query("a1_class_all", with_views("""
SELECT classification, count(*) AS ingredientes,
       CAST(round(sum(count * cost), 0) AS DOUBLE) AS valor_inventario_actual
FROM ingredient_table GROUP BY classification""", ING))
def a1_class_all(spark, sf):
    return I.by_class(Tables.of(spark, sf).ing, "all")


@query("a1_class_costed", with_views("""
SELECT classification, count(*) AS cantidad,
       CAST(round(sum(count * cost), 0) AS DOUBLE) AS valor_total
FROM ingredient_table WHERE cost > 0 GROUP BY classification""", ING))
def a1_class_costed(spark, sf):
    return I.by_class(Tables.of(spark, sf).ing, "costed")


@query("a1_class_null_bucket", with_views("""
SELECT CASE WHEN classification IS NULL OR classification = '' THEN 'Sin clasificar'
            ELSE classification END AS name,
       count(*) AS count,
       CAST(round(sum(coalesce(cost, 0) * coalesce(count, 0)), 0) AS DOUBLE) AS cost
FROM ingredient_table GROUP BY 1""", ING))
def a1_class_null_bucket(spark, sf):
    return I.by_class(Tables.of(spark, sf).ing, "null_bucket")


@query("a2_supplier_sql", with_views("""
SELECT supplier, count(*) AS productos, CAST(round(sum(count * cost), 0) AS DOUBLE) AS valor_inventario
FROM ingredient_table WHERE supplier IS NOT NULL AND supplier <> '' AND cost > 0
GROUP BY supplier ORDER BY valor_inventario DESC, supplier LIMIT 10""", ING))
def a2_supplier_sql(spark, sf):
    return I.by_supplier(Tables.of(spark, sf).ing, "sql")


@query("a2_supplier_api", with_views("""
SELECT CASE WHEN supplier IS NULL OR supplier = '' THEN 'Sin proveedor' ELSE supplier END AS name,
       count(*) AS count,
       CAST(round(sum(coalesce(cost, 0) * coalesce(count, 0)), 0) AS DOUBLE) AS cost
FROM ingredient_table GROUP BY 1 ORDER BY cost DESC, name LIMIT 10""", ING))
def a2_supplier_api(spark, sf):
    return I.by_supplier(Tables.of(spark, sf).ing, "api")


@query("a3_kpis", with_views(f"""
SELECT 'Valor Total Inventario' AS kpi, CAST(round(sum(count * cost), 0) AS DOUBLE) AS valor
  FROM ingredient_table WHERE cost > 0
UNION ALL SELECT 'Total Ingredientes', CAST(count(*) AS DOUBLE) FROM ingredient_table
UNION ALL SELECT 'Platos en Menú', CAST(count(*) AS DOUBLE) FROM menu_board
UNION ALL SELECT 'Ventas Totales', CAST(round(sum(total_sale), 0) AS DOUBLE) FROM daily_sales
UNION ALL SELECT 'Ganancia Neta', CAST(round(sum(total_profit), 0) AS DOUBLE) FROM daily_sales
UNION ALL SELECT 'Ventas Hoy', CAST(round(sum(total_sale), 0) AS DOUBLE) FROM daily_sales
  WHERE CAST(created_at AS DATE) = DATE '{AS_OF}'""", ING, "menu_board", "daily_sales"))
def a3_kpis(spark, sf):
    t = Tables.of(spark, sf)
    return I.kpis(t.ing, t.menu, t.sales, AS_OF)


@query("p8_low_stock_report", with_views("""
SELECT name, measure, CAST(count AS DOUBLE) AS stock_actual, CAST(min_stock AS DOUBLE) AS min_stock,
       CAST(round(count - min_stock, 2) AS DOUBLE) AS diferencia,
       CASE WHEN count <= 0 THEN 'SIN STOCK' WHEN count < min_stock THEN 'BAJO' ELSE 'OK' END AS estado
FROM ingredient_table WHERE count <= min_stock""", ING))
def p8_low_stock_report(spark, sf):
    return I.low_stock_report(Tables.of(spark, sf).ing)


@query("p8_low_stock_dashboard", with_views("""
SELECT name, measure, CAST(round(count, 1) AS DOUBLE) AS stock_actual,
       CAST(round(min_stock, 1) AS DOUBLE) AS stock_minimo,
       CAST(round(count - min_stock, 1) AS DOUBLE) AS diferencia,
       CASE WHEN count <= 0 THEN '🔴 SIN STOCK' WHEN count < min_stock THEN '🟡 BAJO'
            ELSE '🟢 OK' END AS estado
FROM ingredient_table WHERE count <= min_stock ORDER BY diferencia, name LIMIT 30""", ING))
def p8_low_stock_dashboard(spark, sf):
    return I.low_stock_dashboard(Tables.of(spark, sf).ing)


@query("p9_low_stock_api", with_views("""
SELECT name, coalesce(measure, '') AS measure, CAST(coalesce(count, 0) AS DOUBLE) AS stock,
       CAST(coalesce(min_stock, 0) AS DOUBLE) AS min,
       CASE WHEN coalesce(count, 0) - coalesce(min_stock, 0) < 0 THEN 'SIN STOCK' ELSE 'BAJO' END AS badge
FROM ingredient_table WHERE coalesce(count, 0) <= coalesce(min_stock, 0)""", ING))
def p9_low_stock_api(spark, sf):
    return I.low_stock_api(Tables.of(spark, sf).ing)


@query("p10_stock_health", with_views("""
SELECT *, CASE WHEN ingredient_count = 0 THEN 0.0
               ELSE round(CAST(ok AS DOUBLE) * 100 / CAST(ingredient_count AS DOUBLE), 0) END AS health_pct
FROM (SELECT count(*) AS ingredient_count,
             CAST(round(coalesce(sum(coalesce(count, 0) * coalesce(cost, 0)), 0), 2) AS DOUBLE)
               AS total_inventory_value,
             count(*) FILTER (WHERE coalesce(count, 0) >= 5) AS ok,
             count(*) FILTER (WHERE coalesce(count, 0) > 0 AND coalesce(count, 0) < 5) AS low,
             count(*) FILTER (WHERE coalesce(count, 0) <= 0) AS out
      FROM ingredient_table) s""", ING))
def p10_stock_health(spark, sf):
    return I.stock_health(Tables.of(spark, sf).ing)


@query("p11_inventory_filter_low", with_views("""
SELECT * REPLACE (CAST(count AS DOUBLE) AS count, CAST(cost AS DOUBLE) AS cost, CAST(min_stock AS DOUBLE) AS min_stock)
FROM ingredient_table WHERE lower(name) LIKE '%bolt%' AND count < 5""", ING))
def p11_inventory_filter_low(spark, sf):
    return decimals_as_double(I.inventory_filter(Tables.of(spark, sf).ing, "Bolt", "low"))


@query("p11_inventory_filter_ok", with_views("""
SELECT * REPLACE (CAST(count AS DOUBLE) AS count, CAST(cost AS DOUBLE) AS cost, CAST(min_stock AS DOUBLE) AS min_stock)
FROM ingredient_table WHERE lower(name) LIKE '%red%' AND count >= 5""", ING))
def p11_inventory_filter_ok(spark, sf):
    return decimals_as_double(I.inventory_filter(Tables.of(spark, sf).ing, "RED", "ok"))


@query("p12_row_totals", with_views("""
SELECT name, CAST(coalesce(count, 0) * coalesce(cost, 0) AS DOUBLE) AS total FROM ingredient_table""", ING))
def p12_row_totals(spark, sf):
    return I.row_totals(Tables.of(spark, sf).ing)


@query("p13_row_search", with_views("""
SELECT * REPLACE (CAST(count AS DOUBLE) AS count, CAST(cost AS DOUBLE) AS cost, CAST(min_stock AS DOUBLE) AS min_stock) FROM ingredient_table
WHERE lower(coalesce(CAST(name AS VARCHAR), '')) LIKE '%brand#1%'
   OR lower(coalesce(CAST(count AS VARCHAR), '')) LIKE '%brand#1%'
   OR lower(coalesce(CAST(cost AS VARCHAR), '')) LIKE '%brand#1%'
   OR lower(coalesce(measure, '')) LIKE '%brand#1%'
   OR lower(coalesce(classification, '')) LIKE '%brand#1%'
   OR lower(coalesce(brand, '')) LIKE '%brand#1%'
   OR lower(coalesce(supplier, '')) LIKE '%brand#1%'
   OR lower(coalesce(presentation, '')) LIKE '%brand#1%'
   OR lower(coalesce(CAST(min_stock AS VARCHAR), '')) LIKE '%brand#1%'""", ING))
def p13_row_search(spark, sf):
    return decimals_as_double(I.row_search(Tables.of(spark, sf).ing, "Brand#1"))


@query("p14_name_search", with_views("""
SELECT count(*) FILTER (WHERE lower(dish_name) LIKE '%widget%') AS matches, count(*) AS total
FROM menu_board""", "menu_board"))
def p14_name_search(spark, sf):
    return I.name_search_count(Tables.of(spark, sf).menu, "dish_name", "Widget")


@query("p15_sellable_dishes", with_views("""
SELECT id, dish_name, category, portion_weight_g FROM menu_board WHERE portion_weight_g > 0""",
                                      "menu_board"))
def p15_sellable_dishes(spark, sf):
    return Tables.of(spark, sf).menu.filter(F.col("portion_weight_g") > 0).select(
        "id", "dish_name", "category", "portion_weight_g")


@query("t1_top_costly", with_views("""
SELECT name, CAST(round(cost, 0) AS DOUBLE) AS costo_unitario, measure,
       CAST(round(count * cost, 0) AS DOUBLE) AS valor_total_inventario
FROM ingredient_table WHERE cost > 0 ORDER BY cost DESC, name LIMIT 20""", ING))
def t1_top_costly(spark, sf):
    return I.top_costly(Tables.of(spark, sf).ing)


@query("t2_top_dish_cost", with_views("""
SELECT dish_name, category, CAST(cost_total AS DOUBLE) AS costo_plato,
       CAST(sale_price AS DOUBLE) AS sale_price,
       round((sale_price - cost_total) / nullif(sale_price, 0) * 100, 1) AS margen_porcentaje
FROM menu_board WHERE cost_total > 0 ORDER BY cost_total DESC, id LIMIT 20""", "menu_board"))
def t2_top_dish_cost(spark, sf):
    return I.top_dish_cost(Tables.of(spark, sf).menu)


@query("t3_top_margin", with_views("""
SELECT dish_name, costo_plato, precio_venta, ganancia_neta, margen_pct FROM (
  SELECT id, dish_name, CAST(round(cost_total, 0) AS DOUBLE) AS costo_plato,
         CAST(round(sale_price, 0) AS DOUBLE) AS precio_venta,
         CAST(round(sale_price - cost_total, 0) AS DOUBLE) AS ganancia_neta,
         round((sale_price - cost_total) / nullif(sale_price, 0) * 100, 1) AS margen_pct
  FROM menu_board WHERE cost_total > 0 AND sale_price > 0
  ORDER BY margen_pct DESC, id LIMIT 20) t""", "menu_board"))
def t3_top_margin(spark, sf):
    return I.top_margin(Tables.of(spark, sf).menu)


@query("t5_top_value_ingredients", with_views("""
SELECT name, CAST(round(coalesce(count, 0) * coalesce(cost, 0), 2) AS DOUBLE) AS value,
       CAST(count AS DOUBLE) AS count, measure
FROM ingredient_table ORDER BY value DESC, name LIMIT 10""", ING))
def t5_top_value_ingredients(spark, sf):
    return I.top_value(Tables.of(spark, sf).ing)


def _page_sql(page_no: int) -> str:
    return with_views(f"""
WITH n AS (SELECT count(*) AS total FROM ingredient_table),
     p AS (SELECT least(greatest({page_no}, 1), greatest(1, CAST(ceil(total / 10.0) AS BIGINT))) AS pg,
                  total FROM n),
     r AS (SELECT i.*, row_number() OVER (ORDER BY name) AS rn FROM ingredient_table i)
SELECT r.name, CAST(r.count AS DOUBLE) AS count, CAST(r.cost AS DOUBLE) AS cost, r.measure,
       r.classification, r.brand, r.supplier, r.presentation,
       CAST(r.min_stock AS DOUBLE) AS min_stock, CAST(p.pg AS INTEGER) AS page, CAST((p.pg - 1) * 10 + 1 AS INTEGER) AS from_row,
       CAST(least(p.pg * 10, p.total) AS INTEGER) AS to_row, p.total AS total
FROM r, p WHERE r.rn > (p.pg - 1) * 10 AND r.rn <= p.pg * 10""", ING)


@query("t7_inventory_page", _page_sql(3))
def t7_inventory_page(spark, sf):
    return decimals_as_double(I.page(Tables.of(spark, sf).ing, ["name"], 3))


@query("t7_inventory_page_clamped", _page_sql(100000))
def t7_inventory_page_clamped(spark, sf):
    return decimals_as_double(I.page(Tables.of(spark, sf).ing, ["name"], 100000))


@query("a24_suppliers", with_views("""
SELECT trim(min(supplier)) AS supplier FROM ingredient_table
WHERE supplier IS NOT NULL AND trim(supplier) <> ''
GROUP BY lower(trim(supplier))""", ING))
def a24_suppliers(spark, sf):
    return I.suppliers(Tables.of(spark, sf).ing)


@query("a25_ingredient_names", with_views("SELECT name FROM ingredient_table ORDER BY name", ING))
def a25_ingredient_names(spark, sf):
    return Tables.of(spark, sf).ing.select("name").orderBy("name")


@query("a25_nutrition_sorted", with_views("""
SELECT ingredient_name, CAST(protein_g AS DOUBLE) AS protein_g, CAST(total_calories AS DOUBLE) AS total_calories
FROM nutrition_table ORDER BY ingredient_name""", "nutrition_table"))
def a25_nutrition_sorted(spark, sf):
    return Tables.of(spark, sf).nut.select(
        "ingredient_name", F.col("protein_g").cast("double").alias("protein_g"),
        F.col("total_calories").cast("double").alias("total_calories")).orderBy("ingredient_name")


@query("a25_recipe_items_total", with_views("""
SELECT dish_id, ingredient_name, CAST(quantity_grams AS DOUBLE) AS quantity_grams,
       count(*) OVER () AS total
FROM menu_recipe_items""", "menu_board", "menu_recipe_items"))
def a25_recipe_items_total(spark, sf):
    items = Tables.of(spark, sf).items
    total = items.select(F.count(F.lit(1))).scalar()
    return items.select("dish_id", "ingredient_name",
                        F.col("quantity_grams").cast("double").alias("quantity_grams"),
                        total.alias("total")).orderBy("dish_id", "ingredient_name")


@query("w1_stock_bar", with_views("""
SELECT name, CAST(count AS DOUBLE) AS count,
       least(CAST(count AS DOUBLE) / CAST((SELECT greatest(max(count), 1) FROM ingredient_table) AS DOUBLE) * 100,
             100.0) AS bar_pct
FROM ingredient_table""", ING))
def w1_stock_bar(spark, sf):
    return I.stock_bar(Tables.of(spark, sf).ing)


@query("w4_category_breaks", with_views("""
SELECT id, category, sort_order,
       row_number() OVER (PARTITION BY category ORDER BY sort_order, id) = 1 AS category_header
FROM menu_board""", "menu_board"))
def w4_category_breaks(spark, sf):
    return I.category_breaks(Tables.of(spark, sf).menu)


@query("a30_category_counts", with_views("""
SELECT CASE WHEN category IS NULL OR category = '' THEN 'Sin categoria' ELSE category END AS category,
       count(*) AS dishes
FROM menu_board GROUP BY 1""", "menu_board"))
def a30_category_counts(spark, sf):
    return I.category_counts(Tables.of(spark, sf).menu)


@query("a32_load_totals", with_views("""
SELECT 'dishes_by_category' AS kind, category AS key, count(*) AS n FROM menu_board GROUP BY category
UNION ALL
SELECT 'ingredients_by_class', coalesce(trim(classification), ''), count(*) FROM ingredient_table
GROUP BY coalesce(trim(classification), '')
UNION ALL SELECT 'ingredients_total', 'all', count(*) FROM ingredient_table
UNION ALL SELECT 'dishes_total', 'all', count(*) FROM menu_board""", ING, "menu_board"))
def a32_load_totals(spark, sf):
    t = Tables.of(spark, sf)
    cls = F.coalesce(normalise_class("classification"), F.lit(""))
    return (t.menu.groupBy(F.lit("dishes_by_category").alias("kind"), F.col("category").alias("key"))
            .agg(F.count(F.lit(1)).alias("n"))
            .unionByName(t.ing.groupBy(F.lit("ingredients_by_class").alias("kind"), cls.alias("key"))
                         .agg(F.count(F.lit(1)).alias("n")))
            .unionByName(t.ing.agg(F.lit("ingredients_total").alias("kind"), F.lit("all").alias("key"),
                                   F.count(F.lit(1)).alias("n")))
            .unionByName(t.menu.agg(F.lit("dishes_total").alias("kind"), F.lit("all").alias("key"),
                                    F.count(F.lit(1)).alias("n"))))


@query("k3_inventory_export", with_views("""
SELECT coalesce(classification, '') AS "Clasificacion", name AS "Producto", coalesce(brand, '') AS "Marca",
       coalesce(supplier, '') AS "Proveedor", coalesce(presentation, '') AS "Presentacion",
       measure AS "Unidad", CAST(count AS DOUBLE) AS "Cantidad", CAST(cost AS DOUBLE) AS "Costo/Unidad",
       CAST(coalesce(count, 0) * coalesce(cost, 0) AS DOUBLE) AS "Valor Total", '' AS "Observacion"
FROM ingredient_table""", ING))
def k3_inventory_export(spark, sf):
    return inventory_export_frame(Tables.of(spark, sf).ing)


# ------------------------------------------------------------------- T8 two-key orders
@query("t8_menu_by_position", with_views("""
SELECT category, sort_order, id, dish_name FROM menu_board ORDER BY category, sort_order, id""", "menu_board"))
def t8_menu_by_position(spark, sf):
    return Tables.of(spark, sf).menu.select("category", "sort_order", "id", "dish_name").orderBy(
        "category", "sort_order", "id")


@query("t8_menu_by_name", with_views("""
SELECT category, dish_name, id FROM menu_board ORDER BY category, dish_name, id""", "menu_board"))
def t8_menu_by_name(spark, sf):
    return Tables.of(spark, sf).menu.select("category", "dish_name", "id").orderBy("category", "dish_name", "id")


@query("t8_prices_by_ingredient", with_views("""
SELECT ingrediente, supermercado, fecha_scrape, CAST(precio AS DOUBLE) AS precio FROM precios_competencia
ORDER BY ingrediente, supermercado, fecha_scrape""", "precios_competencia"))
def t8_prices_by_ingredient(spark, sf):
    return Tables.of(spark, sf).prices.select(
        "ingrediente", "supermercado", "fecha_scrape", F.col("precio").cast("double").alias("precio")).orderBy(
        "ingrediente", "supermercado", "fecha_scrape")


# ------------------------------------------------------------------- sinks, read back
def _folder(spark, name: str) -> str:
    import uuid
    from mise.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("k1_full_refresh", with_views("SELECT name, measure, CAST(cost AS DOUBLE) AS cost FROM ingredient_table", ING))
def k1_full_refresh(spark, sf):
    """K1: a table with other columns is overwritten by the ingredient table and read back."""
    from mise.sources.sinks import write_full
    t, path = Tables.of(spark, sf), _folder(spark, "k1")
    write_full(t.menu.select("id", "dish_name"), path)
    write_full(t.ing.select("name", "measure", F.col("cost").cast("double").alias("cost")), path)
    return spark.read.parquet(path)


@query("k2_day_replace", with_views("""
SELECT ingrediente, supermercado, CAST(precio + CASE WHEN fecha_scrape = (SELECT max(fecha_scrape) FROM precios_competencia)
         THEN 1 ELSE 0 END AS DOUBLE) AS precio, fecha_scrape
FROM precios_competencia
WHERE fecha_scrape <> (SELECT min(fecha_scrape) FROM precios_competencia)""", "precios_competencia"))
def k2_day_replace(spark, sf):
    """K2: the newest day is replaced (twice: a replay), the oldest day comes without rows."""
    from mise.sources.sinks import replace_days
    path = _folder(spark, "k2")
    p = Tables.of(spark, sf).prices.select("ingrediente", "supermercado", F.col("precio").cast("double").alias("precio"),
                                           "fecha_scrape")
    replace_days(p, path)
    ends = p.agg(F.min("fecha_scrape").alias("a"), F.max("fecha_scrape").alias("b")).first()
    new = p.filter(F.col("fecha_scrape") == F.lit(ends["b"])).withColumn("precio", F.col("precio") + 1)
    replace_days(new, path, days=[str(ends["b"])])
    replace_days(new, path, days=[str(ends["b"])])
    replace_days(p.limit(0), path, days=[str(ends["a"])])
    return spark.read.parquet(path).select("ingrediente", "supermercado", "precio", "fecha_scrape")
