"""Ingredient demand, shopping list and purchase order (A15-A17; J8, J9, J12).

Shopping list, set form of the two reference loops (one pass over ingredients):

    stock = coalesce(count, 0), mn = coalesce(min_stock, 0)
    base  = greatest(0, needed - stock) if needed is known else 0
    short = greatest(base, mn - stock) if stock < mn else base      -> keep short > 0
    reason = 'menu_needed' if needed is known and needed > stock else 'min_stock'

The second loop only adds names the first did not emit, and the first skips a name
only when missing <= 0 and stock >= mn, which the second also skips - so the union of
the two loops is this single pass. ``needed`` stays NULL when absent (not 0).

Scale: demand is computed per recipe (dish-sized) before it meets the ingredient
table; sales history is reduced to units per dish before the recipe explosion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.functions.expr import display_qty, stock_display, stock_unit_label
from mise.operators.costing import recipe_key
from mise.operators.sales import units_by_dish

NO_SUPPLIER = "Sin proveedor"


def demand_from_stock(items: DataFrame) -> DataFrame:
    """A15 stock mode: sum of grams over all recipe lines, per ingredient name."""
    return items.groupBy("ingredient_name").agg(F.sum("quantity_grams").alias("needed"))


def _explode_units(items: DataFrame, units: DataFrame) -> DataFrame:
    """grams x units per ingredient, joining dish units on the J8 recipe key."""
    lines = items.select(recipe_key().alias("dish_id"), "ingredient_name", "quantity_grams")
    return (lines.join(units, "dish_id", "inner")
            .groupBy("ingredient_name")
            .agg(F.sum(F.col("quantity_grams") * F.col("units")).alias("needed")))


def demand_from_sales(items: DataFrame, projections: DataFrame, sales: DataFrame,
                      sale_items: DataFrame, since) -> DataFrame:
    """A15 sales mode: if any projection is active, grams x projected units over the
    active projections (rows of one dish add up); otherwise grams x units sold since
    ``since``. The "any active" test is an EXISTS subquery; the branch that does not
    apply sees an empty input, which AQE propagates so its scan is skipped.
    """
    active = projections.filter(F.col("is_active"))
    has_active = active.exists()   # EXISTS subquery, evaluated once
    proj_units = (active.filter(has_active)
                  .groupBy("dish_id").agg(F.sum("projected_units").cast("bigint").alias("units")))
    recent = sales.filter(~has_active)
    sold_units = units_by_dish(recent, sale_items, since)
    return _explode_units(items, proj_units.unionByName(sold_units))


def shopping_list(ing: DataFrame, demand: DataFrame) -> DataFrame:
    """One row per ingredient to buy, sorted by name (J9: demand names with no
    ingredient are dropped)."""
    j = ing.join(demand, ing.name == demand.ingredient_name, "left")
    stock = F.coalesce(F.col("count"), F.lit(0))
    mn = F.coalesce(F.col("min_stock"), F.lit(0))
    needed = F.col("needed")
    base = F.when(needed.isNotNull(), F.greatest(F.lit(0), needed - stock)).otherwise(F.lit(0))
    short = F.when(stock < mn, F.greatest(base, mn - stock)).otherwise(base)
    j = j.withColumn("short", short).filter(F.col("short") > 0)
    measure = F.col("measure")
    qty = display_qty(F.col("short"), measure)
    cost = F.coalesce(F.col("cost"), F.lit(0))
    return j.select(
        "name",
        qty.cast("double").alias("qty"),
        measure.alias("measure"),
        cost.cast("double").alias("cost"),
        F.coalesce(F.nullif(F.col("supplier"), F.lit("")), F.lit(NO_SUPPLIER)).alias("supplier"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.coalesce("presentation", F.lit("")).alias("presentation"),
        F.coalesce("classification", F.lit("")).alias("classification"),
        F.when(needed.isNotNull() & (needed > stock), "menu_needed").otherwise("min_stock")
        .alias("reason"),
        stock_display(stock, measure).alias("current_stock"),
        stock_display(mn, measure).alias("min_stock"),
        stock_unit_label(measure).alias("stock_measure"),
        (qty * cost).alias("item_cost_dec"),
    ).orderBy("name")


def shopping_total(shop: DataFrame) -> DataFrame:
    """A16 grand total: round(sum(display qty x unit cost), 2), and the row count."""
    return shop.agg(F.round(F.coalesce(F.sum("item_cost_dec"), F.lit(0)), 2).cast("double")
                    .alias("total_cost"), F.count(F.lit(1)).alias("items"))


def purchase_order(lines: DataFrame) -> DataFrame:
    """Lines grouped by supplier with article count and subtotal, and a grand
    total with the supplier count - one ROLLUP(supplier, name) aggregate.

    ``lines``: name, supplier, qty, cost. level: 0 = line, 1 = supplier subtotal,
    3 = grand total (``grouping_id``).
    """
    sup = F.coalesce(F.nullif(F.col("supplier"), F.lit("")), F.lit(NO_SUPPLIER))
    l2 = lines.select(sup.alias("supplier"), "name",
                      (F.col("qty").cast("decimal(20,2)") * F.col("cost").cast("decimal(12,2)"))
                      .alias("line_total"))
    return l2.rollup("supplier", "name").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("articles"),
        F.round(F.sum("line_total"), 2).cast("double").alias("amount"),
        F.count_distinct("supplier").alias("suppliers"))
