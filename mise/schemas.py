"""Explicit schemas of the application's tables, replacing inference.

Money and quantities are exact decimals: DECIMAL(12,2) for amounts and stock,
DECIMAL(10,2) for grams and menu prices, DECIMAL(10,4) for recipe unit costs (D3).
``conform`` casts a frame to a schema by name (missing columns become NULL), so
every loader and adapter hands the operators the same types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

M12 = T.DecimalType(12, 2)
Q10 = T.DecimalType(10, 2)
U10 = T.DecimalType(10, 4)
N8 = T.DecimalType(8, 2)
S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
TS, DT = T.TimestampType(), T.DateType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


INGREDIENT = _schema(("name", S), ("count", M12), ("cost", M12), ("measure", S), ("classification", S),
                     ("brand", S), ("supplier", S), ("presentation", S), ("min_stock", M12),
                     ("notes", S), ("user_id", S))
MENU_BOARD = _schema(("id", L), ("category", S), ("dish_name", S), ("sort_order", I), ("status", S),
                     ("cost_total", Q10), ("overhead_cost", Q10), ("sale_price", Q10),
                     ("portion_weight_g", I), ("protein_g", N8), ("calories", N8), ("carbs_g", N8),
                     ("fat_g", N8), ("fiber_g", N8), ("sodium_mg", N8), ("created_at", TS))
MENU_RECIPE_ITEMS = _schema(("id", L), ("dish_id", L), ("menu_item_id", L), ("ingredient_name", S),
                            ("quantity_grams", Q10), ("unit_cost", U10))
NUTRITION = _schema(("id", L), ("ingredient_name", S), ("classification", S), ("calories_usda", Q10),
                    ("protein_g", Q10), ("fat_g", Q10), ("carbs_g", Q10), ("fiber_g", Q10),
                    ("sodium_mg", Q10), ("calories_protein", Q10), ("calories_fat", Q10),
                    ("calories_carbs", Q10), ("total_calories", Q10), ("total_calories_no_fiber", Q10))
DAILY_SALES = _schema(("id", L), ("created_at", TS), ("total_sale", M12), ("total_cost", M12),
                      ("total_profit", M12), ("items_count", I))
SALE_ITEMS = _schema(("id", L), ("sale_id", L), ("dish_id", L), ("dish_name", S), ("quantity", I),
                     ("sale_price_unit", Q10), ("cost_per_unit", Q10), ("line_sale", M12),
                     ("line_cost", M12), ("line_profit", M12))
SALES_PROJECTIONS = _schema(("id", L), ("dish_id", L), ("dish_name", S), ("projected_units", I),
                            ("unit_cost", M12), ("total_dish_cost", M12), ("estimated_qty", M12),
                            ("estimated_cost", M12), ("start_date", DT), ("end_date", DT),
                            ("is_active", B), ("created_at", TS), ("updated_at", TS))
PRECIOS_COMPETENCIA = _schema(("ingrediente", S), ("supermercado", S), ("producto", S),
                              ("presentacion", S), ("precio", M12), ("url", S), ("fecha_scrape", DT))
CATALOG_PRODUCTS = _schema(("slug", S), ("name", S), ("description", S), ("price", M12),
                           ("regular_price", M12), ("in_stock", B), ("categories", T.ArrayType(S)),
                           ("tags", T.ArrayType(S)), ("variations", S), ("updated_at", TS),
                           ("menu_board_dish_id", L))
ORDER_ITEM = _schema(("product_id", L), ("name", S), ("quantity", I), ("price", M12), ("total", M12))
CATALOG_ORDERS = _schema(("id", L), ("status", S), ("currency", S), ("date_created", S), ("total", M12),
                         ("customer_name", S), ("customer_email", S), ("customer_phone", S),
                         ("items", T.ArrayType(ORDER_ITEM)), ("shipping_address", S),
                         ("payment_method", S), ("payment_status", S), ("synced_at", TS))
SYNC_LOG = _schema(("id", L), ("sync_type", S), ("status", S), ("message", S), ("items_count", I),
                   ("created_at", TS))
RECIPE = _schema(("recipe_id", L), ("recipe_name", S), ("instructions", S))
RECIPE_INGREDIENT = _schema(("id", L), ("recipe_id", L), ("ingredient_name", S),
                            ("quantity_needed", M12), ("measure", S))
USER_PROFILES = _schema(("id", S), ("email", S), ("role", S), ("created_at", TS))

TABLES = {
    "ingredient_table": INGREDIENT, "menu_board": MENU_BOARD, "menu_recipe_items": MENU_RECIPE_ITEMS,
    "nutrition_table": NUTRITION, "daily_sales": DAILY_SALES, "sale_items": SALE_ITEMS,
    "sales_projections": SALES_PROJECTIONS, "precios_competencia": PRECIOS_COMPETENCIA,
    "catalog_products": CATALOG_PRODUCTS, "catalog_orders": CATALOG_ORDERS,
    "catalog_sync_log": SYNC_LOG, "recipe_table": RECIPE, "recipe_ingredients_table": RECIPE_INGREDIENT,
    "user_profiles": USER_PROFILES,
}


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Select the schema's columns by name with its types; absent columns are NULL.
    Casts are ``try_cast`` so that a bad value becomes NULL instead of failing the job."""
    cols = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    if keep_extra:
        names = set(schema.fieldNames())
        cols += [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*cols)
