"""Registered competitor-price queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mise.operators import prices as PR
from mise.plans.oracle_views import with_views
from mise.plans.registry import Tables, decimals_as_double, query

PRICE_DAY = "2024-01-15"  # the newest scrape day of the fixture = "today" of the price job

# The pivot column of each store.
PIVOT_STORES = {"olimpica": "Olímpica", "carulla": "Carulla", "exito": "Éxito", "makro": "Makro"}


def _store_average(column: str) -> str:
    """One lookup per cell: the average over the store's rows of the ingredient."""
    return (f"(SELECT CAST(round(avg(p.precio), 0) AS DOUBLE) FROM precios_competencia p "
            f"WHERE p.ingrediente = t.name AND p.supermercado = '{PIVOT_STORES[column]}') AS {column}")


PIVOT_SQL = f"""
SELECT t.name AS ingrediente, t.supplier AS proveedor, CAST(round(t.cost, 0) AS DOUBLE) AS nuestro_costo,
  {', '.join(map(_store_average, PIVOT_STORES))}
FROM ingredient_table t WHERE t.cost > 0"""


@query("a21_price_pivot", with_views(PIVOT_SQL, "ingredient_table", "precios_competencia"))
def a21_price_pivot(spark, sf):
    t = Tables.of(spark, sf)
    return PR.price_pivot(t.ing, t.prices)


@query("t6_price_pivot_first30", with_views(PIVOT_SQL + " ORDER BY t.name LIMIT 30",
                                            "ingredient_table", "precios_competencia"))
def t6_price_pivot_first30(spark, sf):
    return a21_price_pivot(spark, sf).orderBy("ingrediente").limit(30)


@query("a22_price_latest", with_views("""
SELECT ingrediente, supermercado, CAST(arg_max(precio, fecha_scrape) AS DOUBLE) AS precio,
       max(fecha_scrape) AS fecha_scrape
FROM precios_competencia GROUP BY 1, 2""", "precios_competencia"))
def a22_price_latest(spark, sf):
    return decimals_as_double(PR.price_latest(Tables.of(spark, sf).prices))


def _cell(col: str) -> str:
    return (f"CASE WHEN {col} IS NOT NULL AND coalesce(i.cost, 0) > 0 THEN "
            f"CASE WHEN {col} < coalesce(i.cost, 0) THEN 'cheaper' ELSE 'dearer' END ELSE '' END")


@query("j16_competitor_grid", with_views(f"""
WITH l AS (SELECT ingrediente, supermercado, arg_max(precio, fecha_scrape) AS precio
           FROM precios_competencia GROUP BY 1, 2),
w AS (SELECT ingrediente,
             max(CASE WHEN supermercado = 'Olímpica' THEN precio END) AS o,
             max(CASE WHEN supermercado = 'Carulla' THEN precio END) AS c,
             max(CASE WHEN supermercado = 'Éxito' THEN precio END) AS e,
             max(CASE WHEN supermercado = 'Makro' THEN precio END) AS m
      FROM l GROUP BY 1),
names AS (SELECT DISTINCT ingrediente AS name FROM precios_competencia
          UNION ALL SELECT name FROM ingredient_table
          WHERE NOT EXISTS (SELECT 1 FROM precios_competencia))
SELECT n.name, coalesce(i.measure, '') AS measure, CAST(coalesce(i.cost, 0) AS DOUBLE) AS nuestro_costo,
       CAST(w.o AS DOUBLE) AS olimpica, {_cell('w.o')} AS olimpica_class,
       CAST(w.c AS DOUBLE) AS carulla, {_cell('w.c')} AS carulla_class,
       CAST(w.e AS DOUBLE) AS exito, {_cell('w.e')} AS exito_class,
       CAST(w.m AS DOUBLE) AS makro, {_cell('w.m')} AS makro_class
FROM names n LEFT JOIN ingredient_table i ON i.name = n.name LEFT JOIN w ON w.ingrediente = n.name""",
                                         "ingredient_table", "precios_competencia"))
def j16_competitor_grid(spark, sf):
    t = Tables.of(spark, sf)
    return PR.competitor_grid(t.ing, t.prices)


@query("a23_store_summary", with_views(f"""
SELECT supermercado, count(*) AS productos, CAST(round(avg(precio), 0) AS DOUBLE) AS precio_promedio
FROM precios_competencia WHERE fecha_scrape = DATE '{PRICE_DAY}' GROUP BY 1""", "precios_competencia"))
def a23_store_summary(spark, sf):
    return PR.store_summary(Tables.of(spark, sf).prices, PRICE_DAY)


SEED_SQL = f"""
SELECT i.name AS ingrediente, s.store AS supermercado, i.name AS producto,
       CAST(NULL AS VARCHAR) AS presentacion,
       CAST(round(i.cost * (0.7 + CAST(CAST('0x' || substr(sha256(i.name || '|' || s.store), 1, 8) AS BIGINT)
                                       % 1000000 AS DECIMAL(7,0)) * 0.000001 * 0.8), 0) AS DECIMAL(12,2))
         AS precio,
       '' AS url, DATE '{PRICE_DAY}' AS fecha_scrape
FROM ingredient_table i, (VALUES ('Olímpica'), ('Carulla'), ('Éxito'), ('Makro')) s(store)
WHERE i.cost > 0"""


@query("g3_seed_prices", with_views("SELECT * REPLACE (CAST(precio AS DOUBLE) AS precio) FROM (" + SEED_SQL + ") s",
                                   "ingredient_table"))
def g3_seed_prices(spark, sf):
    return decimals_as_double(PR.seed_prices(Tables.of(spark, sf).ing, PRICE_DAY))


REAL_SQL = f"SELECT * FROM precios_competencia WHERE fecha_scrape = DATE '{PRICE_DAY}'"


@query("u1_real_over_seed_merge", with_views(f"""
SELECT ingrediente, supermercado, producto, presentacion, CAST(precio AS DOUBLE) AS precio, url, fecha_scrape FROM (
  SELECT *, row_number() OVER (PARTITION BY ingrediente, supermercado ORDER BY prio, producto, precio) AS rn
  FROM (SELECT *, 0 AS prio FROM ({REAL_SQL}) r UNION ALL SELECT *, 1 AS prio FROM ({SEED_SQL}) s) x) y
WHERE rn = 1""", "ingredient_table", "precios_competencia"))
def u1_real_over_seed_merge(spark, sf):
    t = Tables.of(spark, sf)
    real = t.prices.filter(F.col("fecha_scrape") == F.lit(PRICE_DAY).cast("date"))
    return decimals_as_double(PR.real_over_seed(real, PR.seed_prices(t.ing, PRICE_DAY)))


@query("u1_real_only", with_views(f"""
SELECT ingrediente, supermercado, producto, presentacion, CAST(precio AS DOUBLE) AS precio, url, fecha_scrape FROM (
  SELECT *, row_number() OVER (PARTITION BY ingrediente, supermercado ORDER BY producto, precio) AS rn
  FROM ({REAL_SQL}) r) x
WHERE rn = 1""", "ingredient_table", "precios_competencia"))
def u1_real_only(spark, sf):
    """U1 without estimates: the other mode of ``u1_real_over_seed_merge``."""
    t = Tables.of(spark, sf)
    real = t.prices.filter(F.col("fecha_scrape") == F.lit(PRICE_DAY).cast("date"))
    return decimals_as_double(PR.real_over_seed(real, PR.seed_prices(t.ing, PRICE_DAY), use_estimates=False))


@query("m6_price_edits", with_views("""
WITH e AS (SELECT p_name || ' #' || CAST(p_partkey AS VARCHAR) AS ingrediente,
                  CASE WHEN p_partkey % 2 = 0 THEN 'Makro' ELSE 'Éxito' END AS supermercado,
                  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'edit ' || CAST(p_partkey AS VARCHAR) END AS producto,
                  CAST(CASE WHEN p_partkey % 33 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(12,2)) AS precio
           FROM part WHERE p_partkey % 11 = 0),
cur AS (SELECT ingrediente, supermercado, producto, precio, fecha_scrape FROM precios_competencia
        WHERE fecha_scrape = DATE '2024-01-15'),
ok AS (SELECT ingrediente, supermercado, coalesce(producto, ingrediente) AS producto, precio,
              DATE '2024-01-20' AS fecha_scrape FROM e WHERE precio > 0)
SELECT coalesce(c.ingrediente, o.ingrediente) AS ingrediente, coalesce(c.supermercado, o.supermercado) AS supermercado,
       CASE WHEN o.ingrediente IS NOT NULL THEN o.producto ELSE c.producto END AS producto,
       CAST(CASE WHEN o.ingrediente IS NOT NULL THEN o.precio ELSE c.precio END AS DOUBLE) AS precio,
       CASE WHEN o.ingrediente IS NOT NULL THEN o.fecha_scrape ELSE c.fecha_scrape END AS fecha_scrape
FROM cur c FULL OUTER JOIN ok o ON o.ingrediente = c.ingrediente AND o.supermercado = c.supermercado""",
                                    "precios_competencia"))
def m6_price_edits(spark, sf):
    """M6: price edits from the price screen merged into the day's prices by
    (ingredient, store); product defaults to the ingredient; price 0 is rejected (M8)."""
    from mise.operators.mutations import upsert
    from mise.sources.adapters import ingredient_name
    t = Tables.of(spark, sf)
    pk = F.col("p_partkey")
    edits = t.raw("part").filter(pk % 11 == 0).select(
        ingredient_name(pk, F.col("p_name")).alias("ingrediente"),
        F.when(pk % 2 == 0, "Makro").otherwise("Éxito").alias("supermercado"),
        F.when(pk % 4 != 0, F.concat(F.lit("edit "), pk.cast("string"))).alias("producto"),
        F.when(pk % 33 == 0, F.lit(0)).otherwise(F.col("p_retailprice")).cast("decimal(12,2)").alias("precio"))
    rows, _rejected = PR.price_edits(edits, "2024-01-20")
    cur = t.prices.filter(F.col("fecha_scrape") == F.lit(PRICE_DAY).cast("date")).select(
        "ingrediente", "supermercado", "producto", "precio", "fecha_scrape")
    out = upsert(cur, rows.select("ingrediente", "supermercado", "producto", "precio", "fecha_scrape"),
                 ["ingrediente", "supermercado"])
    return out.withColumn("precio", F.col("precio").cast("double"))


@query("t6_preview_first8", with_views("SELECT * REPLACE (CAST(cost_total AS DOUBLE) AS cost_total, CAST(overhead_cost AS DOUBLE) AS overhead_cost, CAST(sale_price AS DOUBLE) AS sale_price) FROM menu_board ORDER BY id LIMIT 8",
                                      "menu_board"))
def t6_preview_first8(spark, sf):
    """The table browser's 8-row preview (S11 + limit)."""
    from mise.sources.loaders import browse
    t = Tables.of(spark, sf)
    return decimals_as_double(browse({"menu_board": t.menu}, "menu_board").orderBy("id").limit(8))
