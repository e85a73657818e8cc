"""Registered mutation queries (M1-M9, U4). Change sets are derived from the test
tables, so every query grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from mise.functions.expr import MONEY
from mise.operators import mutations as M
from mise.operators.prices import price_latest
from mise.plans.oracle_views import with_views
from mise.plans.registry import AS_OF, Tables, query


def _profile_changes(t: Tables):
    c = t.raw("customer")
    k, bal = F.col("c_custkey"), F.col("c_acctbal").cast(MONEY)
    vip = c.filter(k % 5 == 0).select(k.alias("id"), F.lit("VIP").alias("role"),
                                      (bal + 100).cast(MONEY).alias("balance"), F.lit(1).alias("seq"))
    plat = c.filter(k % 10 == 0).select(k.alias("id"), F.lit("PLATINUM").alias("role"),
                                        (bal + 200).cast(MONEY).alias("balance"), F.lit(2).alias("seq"))
    new = c.filter(k % 50 == 0).select((k + 1000000).alias("id"), F.lit("NEW").alias("role"),
                                       F.lit(0).cast(MONEY).alias("balance"), F.lit(1).alias("seq"))
    return vip.unionByName(plat).unionByName(new)


CHG_SQL = """
SELECT c_custkey AS id, 'VIP' AS role, CAST(CAST(c_acctbal AS DECIMAL(12,2)) + 100 AS DECIMAL(12,2)) AS balance,
       1 AS seq FROM customer WHERE c_custkey % 5 = 0
UNION ALL
SELECT c_custkey, 'PLATINUM', CAST(CAST(c_acctbal AS DECIMAL(12,2)) + 200 AS DECIMAL(12,2)), 2
FROM customer WHERE c_custkey % 10 = 0
UNION ALL
SELECT c_custkey + 1000000, 'NEW', CAST(0 AS DECIMAL(12,2)), 1 FROM customer WHERE c_custkey % 50 = 0"""


@query("m1_upsert_profiles", with_views(f"""
WITH chg AS ({CHG_SQL}),
last AS (SELECT id, arg_max(role, seq) AS role, arg_max(balance, seq) AS balance FROM chg GROUP BY id)
SELECT coalesce(c.id, l.id) AS id, c.email,
       CASE WHEN l.id IS NOT NULL THEN l.role ELSE c.role END AS role,
       CAST(CASE WHEN l.id IS NOT NULL THEN l.balance ELSE c.balance END AS DOUBLE) AS balance
FROM user_profiles c FULL OUTER JOIN last l ON l.id = c.id""", "user_profiles"))
def m1_upsert_profiles(spark, sf):
    t = Tables.of(spark, sf)
    out = M.upsert(t.profiles, _profile_changes(t), ["id"], order="seq")
    return out.withColumn("balance", F.col("balance").cast("double"))


@query("m1_upsert_idempotent", with_views(f"""
WITH chg AS ({CHG_SQL}),
last AS (SELECT id, arg_max(role, seq) AS role, arg_max(balance, seq) AS balance FROM chg GROUP BY id)
SELECT coalesce(c.id, l.id) AS id, c.email,
       CASE WHEN l.id IS NOT NULL THEN l.role ELSE c.role END AS role,
       CAST(CASE WHEN l.id IS NOT NULL THEN l.balance ELSE c.balance END AS DOUBLE) AS balance
FROM user_profiles c FULL OUTER JOIN last l ON l.id = c.id""", "user_profiles"))
def m1_upsert_idempotent(spark, sf):
    """Applying the same change set twice gives the once-applied table."""
    t = Tables.of(spark, sf)
    chg = _profile_changes(t)
    once = M.upsert(t.profiles, chg, ["id"], order="seq")
    twice = M.upsert(once, chg, ["id"], order="seq")
    return twice.withColumn("balance", F.col("balance").cast("double"))


@query("m2_patch_projections", with_views(f"""
SELECT p.id, p.dish_id, p.dish_name,
       CASE WHEN c.id IS NOT NULL THEN c.projected_units ELSE p.projected_units END AS projected_units,
       CASE WHEN c.id IS NOT NULL THEN c.is_active ELSE p.is_active END AS is_active,
       CASE WHEN c.id IS NOT NULL THEN DATE '{AS_OF}' END AS updated_at
FROM projection_rows p LEFT JOIN (
  SELECT id, projected_units * 2 AS projected_units, false AS is_active FROM projection_rows WHERE id % 20 = 0
) c ON c.id = p.id""", "projection_rows"))
def m2_patch_projections(spark, sf):
    t = Tables.of(spark, sf)
    p = t.proj_rows
    chg = p.filter(F.col("id") % 20 == 0).select(
        "id", (F.col("projected_units") * 2).alias("projected_units"),
        F.lit(False).alias("is_active"), F.lit("NOT ALLOWED").alias("dish_name"))
    stray = p.filter(F.col("id") % 20 == 0).select(
        (-1 - F.col("id")).alias("id"), F.lit(1).alias("projected_units"),
        F.lit(True).alias("is_active"), F.lit("x").alias("dish_name"))
    return M.patch(p, chg.unionByName(stray), ["id"], ["projected_units", "is_active"],
                   order=None, stamp_col="updated_at", stamp=F.lit(AS_OF).cast("date"))


@query("m3_delete_cascade", with_views("""
SELECT r.id, r.dish_id, r.ingredient_name FROM menu_recipe_items r
WHERE r.dish_id IN (SELECT id FROM menu_board WHERE status <> 'inactivo')""",
                                       "menu_board", "menu_recipe_items"))
def m3_delete_cascade(spark, sf):
    t = Tables.of(spark, sf)
    gone = t.menu.filter(F.col("status") == "inactivo").select("id")
    menu = M.delete_keys(t.menu, gone, ["id"])
    return M.cascade(t.items, menu, "dish_id", "id").select("id", "dish_id", "ingredient_name")


@query("m4_replace_children", with_views("""
SELECT id, dish_id, ingredient_name, CAST(quantity_grams AS DOUBLE) AS quantity_grams
FROM menu_recipe_items WHERE dish_id % 20 <> 0
UNION ALL
SELECT dish_id * 10 + 9, dish_id, 'REPLACED', 100.0 FROM (SELECT DISTINCT dish_id FROM menu_recipe_items
                                                         WHERE dish_id % 20 = 0) d""",
                                         "menu_board", "menu_recipe_items"))
def m4_replace_children(spark, sf):
    t = Tables.of(spark, sf)
    items = t.items
    new = items.filter(F.col("dish_id") % 20 == 0).select("dish_id").distinct().select(
        (F.col("dish_id") * 10 + 9).alias("id"), "dish_id", F.lit(None).cast("bigint").alias("menu_item_id"),
        F.lit("REPLACED").alias("ingredient_name"), F.lit(100).cast("decimal(10,2)").alias("quantity_grams"),
        F.lit(1).cast("decimal(10,4)").alias("unit_cost"))
    out = M.replace_children(items, new, "dish_id")
    return out.select("id", "dish_id", "ingredient_name",
                      F.col("quantity_grams").cast("double").alias("quantity_grams"))


@query("m5_restore_cost", with_views("""
SELECT name, CAST(cost AS DOUBLE) AS cost, CAST(count AS DOUBLE) AS count FROM ingredient_table""",
                                     "ingredient_table"))
def m5_restore_cost(spark, sf):
    t = Tables.of(spark, sf)
    damaged = t.ing.withColumn("cost", F.when(F.col("count") > 100, F.col("cost") * 2)
                               .otherwise(F.col("cost")).cast(MONEY))
    snap = t.ing.select("name", "cost")
    out = M.restore_column(damaged, snap, "name", "cost")
    return out.select("name", F.col("cost").cast("double").alias("cost"),
                      F.col("count").cast("double").alias("count"))


@query("m6_price_upsert", with_views("""
WITH cur AS (SELECT ingrediente, supermercado, arg_max(precio, fecha_scrape) AS precio,
                    max(fecha_scrape) AS fecha_scrape
             FROM precios_competencia WHERE fecha_scrape < DATE '2024-01-15' GROUP BY 1, 2),
chg AS (SELECT ingrediente, supermercado, precio, fecha_scrape FROM precios_competencia
        WHERE fecha_scrape = DATE '2024-01-15')
SELECT coalesce(c.ingrediente, n.ingrediente) AS ingrediente,
       coalesce(c.supermercado, n.supermercado) AS supermercado,
       CAST(CASE WHEN n.ingrediente IS NOT NULL THEN n.precio ELSE c.precio END AS DOUBLE) AS precio,
       CASE WHEN n.ingrediente IS NOT NULL THEN n.fecha_scrape ELSE c.fecha_scrape END AS fecha_scrape
FROM cur c FULL OUTER JOIN chg n ON n.ingrediente = c.ingrediente AND n.supermercado = c.supermercado""",
                                     "precios_competencia"))
def m6_price_upsert(spark, sf):
    t = Tables.of(spark, sf)
    day = F.lit("2024-01-15").cast("date")
    cur = price_latest(t.prices.filter(F.col("fecha_scrape") < day))
    chg = t.prices.filter(F.col("fecha_scrape") == day).select(
        "ingrediente", "supermercado", "precio", "fecha_scrape")
    out = M.upsert(cur, chg, ["ingrediente", "supermercado"])
    return out.withColumn("precio", F.col("precio").cast("double"))


def _new_dishes(t: Tables):
    part = t.raw("part")
    pk = F.col("p_partkey")
    return part.filter((pk % 5 == 1) & (pk % 3 == 0)).select(
        pk.alias("id"), F.col("p_type").alias("category"),
        F.concat(F.upper("p_name"), F.lit(" NEW "), pk.cast("string")).alias("dish_name"))


@query("m7_append_dishes", with_views("""
SELECT n.id, n.category, n.dish_name,
       CAST(coalesce(t.mx + 1, 0) + row_number() OVER (PARTITION BY n.category ORDER BY n.id) - 1 AS INTEGER)
         AS sort_order
FROM (SELECT p_partkey AS id, p_type AS category, upper(p_name) || ' NEW ' || CAST(p_partkey AS VARCHAR) AS dish_name
      FROM part WHERE p_partkey % 5 = 1 AND p_partkey % 3 = 0) n
LEFT JOIN (SELECT category, max(sort_order) AS mx FROM menu_board GROUP BY category) t
  ON t.category = n.category""", "menu_board"))
def m7_append_dishes(spark, sf):
    t = Tables.of(spark, sf)
    return M.append_dishes(t.menu, _new_dishes(t)).select("id", "category", "dish_name", "sort_order")


@query("m8_validate_recipe_items", with_views("""
SELECT id, CASE WHEN ingredient_name IS NULL OR trim(ingredient_name) = '' THEN 'missing ingredient name'
                WHEN q <= 0 THEN 'quantity must be > 0' END AS reject_reason
FROM (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE ingredient_name END AS ingredient_name,
             quantity_grams - 150 AS q FROM menu_recipe_items) x""", "menu_board", "menu_recipe_items"))
def m8_validate_recipe_items(spark, sf):
    t = Tables.of(spark, sf)
    x = t.items.select("id", F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(
        F.col("ingredient_name")).alias("ingredient_name"),
        (F.col("quantity_grams") - 150).alias("quantity_grams"))
    good, bad = M.split_valid(x, M.recipe_checks())
    return good.select("id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("id", "reject_reason"))


@query("m8_validate_dishes", with_views("""
SELECT count(*) FILTER (WHERE category IS NOT NULL AND category <> '' AND dish_name IS NOT NULL
                        AND dish_name <> '') AS good,
       count(*) FILTER (WHERE NOT (category IS NOT NULL AND category <> '' AND dish_name IS NOT NULL
                        AND dish_name <> '')) AS rejected
FROM (SELECT CASE WHEN id % 3 = 0 THEN '' ELSE category END AS category, dish_name FROM menu_board) m""",
                                        "menu_board"))
def m8_validate_dishes(spark, sf):
    t = Tables.of(spark, sf)
    m = t.menu.withColumn("category", F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("category")))
    good, bad = M.split_valid(m, M.dish_checks())
    return good.select(F.lit("good").alias("k")).unionByName(bad.select(F.lit("rejected").alias("k"))) \
        .groupBy().pivot("k", ["good", "rejected"]).count().fillna(0)


def _catalog(t: Tables):
    part = t.raw("part")
    pk = F.col("p_partkey")
    matched = part.filter((pk % 5 == 0) & (pk % 3 == 0)).select(
        F.concat(F.lit("p-"), pk.cast("string")).alias("slug"),
        F.concat(F.lit(" "), F.lower(F.concat(F.upper("p_name"), F.lit(" "), pk.cast("string"))),
                 F.lit(" ")).alias("name"))
    unmatched = part.filter((pk % 5 == 1) & (pk % 3 == 0)).select(
        F.concat(F.lit("p-"), pk.cast("string")).alias("slug"),
        F.concat(F.col("p_name"), F.lit(" product")).alias("name"))
    return matched.unionByName(unmatched).withColumn("dish_name", F.lit(""))


@query("m9_align_catalog", with_views("""
WITH prods AS (
  SELECT 'p-' || CAST(p_partkey AS VARCHAR) AS slug,
         ' ' || lower(upper(p_name) || ' ' || CAST(p_partkey AS VARCHAR)) || ' ' AS name
  FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 = 0
  UNION ALL
  SELECT 'p-' || CAST(p_partkey AS VARCHAR), p_name || ' product' FROM part
  WHERE p_partkey % 5 = 1 AND p_partkey % 3 = 0),
mb AS (SELECT upper(trim(dish_name)) AS k, min(id) AS id FROM menu_board GROUP BY 1)
SELECT p.slug, p.name,
       CASE WHEN coalesce(m.dish_name, '') = '' THEN p.name ELSE m.dish_name END AS dish_name,
       CASE WHEN mb.id IS NULL THEN 'General' ELSE m.category END AS category,
       CAST(CASE WHEN mb.id IS NULL THEN 0 ELSE m.cost_total END AS DOUBLE) AS cost_total,
       CAST(CASE WHEN mb.id IS NULL THEN 0 ELSE m.sale_price END AS DOUBLE) AS sale_price,
       mb.id AS menu_board_dish_id
FROM prods p LEFT JOIN mb ON mb.k = upper(trim(p.name)) LEFT JOIN menu_board m ON m.id = mb.id""",
                                      "menu_board"))
def m9_align_catalog(spark, sf):
    t = Tables.of(spark, sf)
    out = M.align_catalog(_catalog(t), t.menu)
    return out.select("slug", "name", "dish_name", "category",
                      F.col("cost_total").cast("double").alias("cost_total"),
                      F.col("sale_price").cast("double").alias("sale_price"), "menu_board_dish_id")
