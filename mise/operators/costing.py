"""Recipe costing, nutrition and recipe checks (A8-A14, A31; joins J3-J7, J11).

One rule for the unit cost of a recipe line (set-based form of the per-item loop):

    unit_cost > 0  -> unit_cost
    otherwise      -> ingredient cost x unit factor (F7), 0 when the ingredient is absent

All money stays an exact decimal until the final round; per-gram costs carry scale 10
because of the pound factor. Outputs are rounded decimals cast to double.

Scale: recipe lines join ingredients on the name (an equi-join on the dimension key);
Spark picks broadcast vs shuffle from the size it measures, so nothing is hinted.
Dish rollups are hash aggregates with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.functions.expr import PER_GRAM, unit_factor


def recipe_key() -> F.Column:
    """J8 key: ``menu_item_id`` when set and non-zero, else ``dish_id``."""
    return F.coalesce(F.nullif(F.col("menu_item_id"), F.lit(0)), F.col("dish_id"))


def per_gram_costs(ing: DataFrame) -> DataFrame:
    return ing.select(
        F.col("name").alias("ingredient_name"),
        (F.col("cost") * unit_factor("measure")).cast(PER_GRAM).alias("ing_unit_cost"))


def costed_lines(items: DataFrame, ing: DataFrame) -> DataFrame:
    """Each recipe line with its effective unit cost and exact line cost."""
    j = items.join(per_gram_costs(ing), "ingredient_name", "left")
    eff = F.when(F.col("unit_cost") > 0, F.col("unit_cost").cast(PER_GRAM)).otherwise(
        F.coalesce(F.col("ing_unit_cost"), F.lit(0).cast(PER_GRAM)))
    return (j.withColumn("eff_unit_cost", eff)
             .withColumn("line_cost_exact", F.col("quantity_grams") * F.col("eff_unit_cost")))


def dish_costs(items: DataFrame, ing: DataFrame, by_recipe_key: bool = False) -> DataFrame:
    """A8 raw cost per dish = round(sum(grams x unit cost), 2), plus count and grams.

    ``by_recipe_key`` groups by the J8 key (projections, demand) instead of dish_id.
    """
    lines = costed_lines(items, ing)
    key = recipe_key() if by_recipe_key else F.col("dish_id")
    return lines.groupBy(key.alias("dish_id")).agg(
        F.round(F.sum("line_cost_exact"), 2).alias("raw_cost_dec"),
        F.count(F.lit(1)).alias("ingredient_count"),
        F.sum("quantity_grams").alias("total_grams"))


def dish_cost_report(menu: DataFrame, items: DataFrame, ing: DataFrame) -> DataFrame:
    """A8 + A9: raw cost, overhead and final cost = round(raw + overhead, 2) per dish.
    Dishes without a recipe keep 0 (J5)."""
    c = dish_costs(items, ing)
    j = menu.select("id", "dish_name", "overhead_cost").join(
        c, menu.id == c.dish_id, "left")
    raw = F.coalesce(F.col("raw_cost_dec"), F.lit(0).cast("decimal(38,2)"))
    return j.select(
        F.col("id").alias("dish_id"), "dish_name",
        raw.cast("double").alias("raw_cost"),
        F.col("overhead_cost").cast("double").alias("overhead_cost"),
        F.round(raw + F.col("overhead_cost"), 2).cast("double").alias("final_cost"),
        F.coalesce("ingredient_count", F.lit(0)).alias("ingredient_count"))


def pos_dishes(menu: DataFrame, items: DataFrame, ing: DataFrame) -> DataFrame:
    """A9 POS form: stored cost_total when > 0 else recomputed; profit and margin
    (0 when the price is 0, API rule)."""
    c = dish_costs(items, ing)
    j = menu.join(c, menu.id == c.dish_id, "left")
    recomputed = F.round(F.coalesce("raw_cost_dec", F.lit(0)) + F.col("overhead_cost"), 2)
    stored = F.coalesce(F.col("cost_total"), F.lit(0))
    final = F.when(stored > 0, stored.cast("decimal(38,2)")).otherwise(recomputed)
    price = F.coalesce(F.col("sale_price"), F.lit(0))
    margin = F.when(price == 0, F.lit(0.0)).otherwise(
        F.round((price - final).cast("double") / price.cast("double") * 100, 1))
    return j.select(
        F.col("id"), "category", "dish_name",
        price.cast("double").alias("sale_price"),
        final.cast("double").alias("cost_total"),
        F.coalesce("portion_weight_g", F.lit(0)).cast("double").alias("portion_weight_g"),
        F.round(price - final, 2).cast("double").alias("profit"),
        margin.cast("double").alias("margin_pct"),
        F.coalesce("ingredient_count", F.lit(0)).alias("recipe_count"))


def recipe_lines(items: DataFrame, ing: DataFrame) -> DataFrame:
    """A10: enriched lines; unit_cost round 4, line_cost round 2."""
    return costed_lines(items, ing).select(
        "id", "dish_id", "ingredient_name",
        F.col("quantity_grams").cast("double").alias("quantity_grams"),
        F.round("eff_unit_cost", 4).cast("double").alias("unit_cost"),
        F.round("line_cost_exact", 2).cast("double").alias("line_cost"))


NUTRIENTS = [("protein_g", "protein_g"), ("fat_g", "fat_g"), ("carbs_g", "carbs_g"),
             ("fiber_g", "fiber_g"), ("sodium_mg", "sodium_mg"), ("total_calories", "calories")]


def dish_nutrition(menu: DataFrame, items: DataFrame, nut: DataFrame) -> DataFrame:
    """sum(measure x grams / 100) per dish; unmatched names add nothing (J4);
    dishes without a recipe get zeros (J5). Grams / 100 is the exact factor 0.01."""
    j = items.join(nut, "ingredient_name", "left")
    factor = F.col("quantity_grams") * F.lit("0.01").cast("decimal(3,2)")
    aggs = [F.sum(F.coalesce(F.col(src), F.lit(0)) * factor).alias(dst) for src, dst in NUTRIENTS]
    per_dish = j.groupBy("dish_id").agg(*aggs)
    m = menu.select(F.col("id").alias("dish_id"), "dish_name")
    out = m.join(per_dish, "dish_id", "left")
    return out.select("dish_id", "dish_name", *[
        F.coalesce(F.col(d), F.lit(0)).cast("double").alias(d) for _, d in NUTRIENTS])


def recipe_size(items: DataFrame) -> DataFrame:
    """Total grams (round 1) and ingredient count per dish."""
    return items.groupBy("dish_id").agg(
        F.round(F.sum("quantity_grams"), 1).cast("double").alias("total_recipe_g"),
        F.count(F.lit(1)).alias("ingredient_count"))


def check_recipes(recipes: DataFrame, lines: DataFrame, ing: DataFrame) -> DataFrame:
    """A13 for all recipes at once (the per-line view with A14 is ``recipe_check_lines``).

    ``recipes``: recipe_id, recipe_name. ``lines``: recipe_id, ingredient_name,
    quantity_needed. An unknown ingredient has stock 0 and cost 0 and is flagged (D14).
    Per recipe: total cost, missing cost (both round 2), line count, missing lines,
    unknown ingredients and all_available. Recipes without lines are all available.
    """
    stock = ing.select(F.col("name").alias("ingredient_name"), "count", "cost")
    j = lines.join(stock, "ingredient_name", "left")
    have = F.coalesce(F.col("count"), F.lit(0))
    cost = F.coalesce(F.col("cost"), F.lit(0))
    need = F.col("quantity_needed")
    missing = F.greatest(F.lit(0), need - have)
    j = j.select("recipe_id", "ingredient_name",
                 (need * cost).alias("line_cost"), (missing * cost).alias("missing_cost"),
                 missing.alias("missing"), F.col("count").isNull().alias("unknown"))
    agg = j.groupBy("recipe_id").agg(
        F.round(F.sum("line_cost"), 2).alias("total_cost"),
        F.round(F.sum("missing_cost"), 2).alias("missing_cost"),
        F.count_if(F.col("missing") > 0).alias("missing_lines"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if("unknown").alias("unknown_ingredients"))
    out = recipes.select("recipe_id", "recipe_name").join(agg, "recipe_id", "left")
    return out.select(
        "recipe_id", "recipe_name",
        F.coalesce("total_cost", F.lit(0)).cast("double").alias("total_cost"),
        F.coalesce("missing_cost", F.lit(0)).cast("double").alias("missing_cost"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("missing_lines", F.lit(0)).alias("missing_lines"),
        F.coalesce("unknown_ingredients", F.lit(0)).alias("unknown_ingredients"),
        (F.coalesce("missing_lines", F.lit(0)) == 0).alias("all_available"))


def recipe_check_lines(lines: DataFrame, ing: DataFrame) -> DataFrame:
    """A13 detail + A14: have, missing, have/need % capped at 100, per line."""
    stock = ing.select(F.col("name").alias("ingredient_name"), "count", "cost")
    j = lines.join(stock, "ingredient_name", "left")
    have = F.coalesce(F.col("count"), F.lit(0))
    need = F.col("quantity_needed")
    pct = F.least(F.try_divide(F.greatest(have, F.lit(0)).cast("double") * 100,
                               need.cast("double")), F.lit(100.0))
    return j.select(
        "recipe_id", "ingredient_name",
        need.cast("double").alias("needed"), have.cast("double").alias("have"),
        F.greatest(F.lit(0), need - have).cast("double").alias("missing"),
        F.round(pct, 1).cast("double").alias("have_pct"))


def recipe_shopping_lines(lines: DataFrame, ing: DataFrame) -> DataFrame:
    """A13 shopping list of every recipe, one row per missing line: the quantity that the
    stock does not cover, its unit and its cost. An unknown ingredient has stock 0, cost 0.
    The unit is the line's where it has one, else the ingredient's."""
    stock = ing.select(F.col("name").alias("ingredient_name"), "count", "cost",
                       F.col("measure").alias("stock_measure"))
    j = lines.join(stock, "ingredient_name", "left")
    qty = F.col("quantity_needed") - F.coalesce("count", F.lit(0))
    measure = F.coalesce("measure", "stock_measure") if "measure" in lines.columns else F.col("stock_measure")
    return j.filter(qty > 0).select(
        "recipe_id", F.col("ingredient_name").alias("name"), qty.cast("double").alias("qty"),
        measure.alias("measure"),
        (qty * F.coalesce("cost", F.lit(0))).cast("double").alias("cost"))


def recipes_with_items(recipes: DataFrame, lines: DataFrame, ing: DataFrame) -> DataFrame:
    """J6 + J7: recipe rows with their lines nested (ingredient stock and cost embedded).

    Lines are grouped per recipe with ``collect_list`` - bounded by one recipe's size.
    A flat summary (count and sorted name list) is returned next to the nested array.
    """
    stock = ing.select(F.col("name").alias("ingredient_name"), "count", "cost")
    j = lines.join(stock, "ingredient_name", "left")
    nested = j.groupBy("recipe_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "ingredient_name", F.col("quantity_needed").cast("double").alias("quantity_needed"),
            F.col("count").cast("double").alias("count"),
            F.col("cost").cast("double").alias("cost")))).alias("ingredients"))
    out = recipes.select("recipe_id", "recipe_name").join(nested, "recipe_id", "left")
    return out.select(
        "recipe_id", "recipe_name",
        F.when(F.col("ingredients").isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.size("ingredients").cast("bigint")).alias("n_ingredients"),
        F.coalesce(F.array_join(F.transform("ingredients", lambda s: s["ingredient_name"]), "|"),
                   F.lit("")).alias("ingredient_names"),
        "ingredients")


def recipe_summary(recipes: DataFrame, lines: DataFrame, ing: DataFrame) -> DataFrame:
    """J6/J7 as bounded aggregates per recipe (a hot recipe never becomes one row of
    unbounded size): line count, first and last ingredient name, total name length,
    and the lines whose ingredient is unknown."""
    names = ing.select(F.col("name").alias("ingredient_name"), F.lit(True).alias("_known"))
    j = lines.join(names, "ingredient_name", "left")
    agg = j.groupBy("recipe_id").agg(
        F.count(F.lit(1)).alias("n_ingredients"),
        F.min("ingredient_name").alias("first_ingredient"),
        F.max("ingredient_name").alias("last_ingredient"),
        F.sum(F.length("ingredient_name")).alias("name_chars"),
        F.count_if(F.col("_known").isNull()).alias("unknown_ingredients"))
    out = recipes.select("recipe_id", "recipe_name").join(agg, "recipe_id", "left")
    return out.select("recipe_id", "recipe_name",
                      F.coalesce("n_ingredients", F.lit(0)).alias("n_ingredients"),
                      "first_ingredient", "last_ingredient",
                      F.coalesce("name_chars", F.lit(0)).cast("bigint").alias("name_chars"),
                      F.coalesce("unknown_ingredients", F.lit(0)).alias("unknown_ingredients"))


def profitability(menu: DataFrame, items: DataFrame, ing: DataFrame, sales: DataFrame,
                  sale_items: DataFrame, since) -> DataFrame:
    """Per dish raw cost, price, units sold since ``since`` (J11/J12), line count.

    The period's sale ids are a semi-join (never an IN list); sale lines are reduced to
    one row per dish before they meet the menu.
    """
    period = sales.filter(F.col("created_at") >= F.lit(since).cast("timestamp")).select(
        F.col("id").alias("sale_id"))
    units = (sale_items.join(period, "sale_id", "left_semi")
             .groupBy("dish_id").agg(F.sum("quantity").alias("units_sold")))
    c = dish_costs(items, ing)
    m = menu.select(F.col("id").alias("dish_id"), "dish_name", "sale_price")
    j = m.join(c, "dish_id", "left").join(units, "dish_id", "left")
    return j.select(
        F.col("dish_id").alias("recipe_id"),
        F.coalesce("dish_name", F.lit("Sin nombre")).alias("recipe_name"),
        F.coalesce("raw_cost_dec", F.lit(0)).cast("double").alias("cost"),
        F.coalesce("ingredient_count", F.lit(0)).alias("ingredient_count"),
        F.coalesce("sale_price", F.lit(0)).cast("double").alias("sale_price"),
        F.coalesce("units_sold", F.lit(0)).cast("bigint").alias("units_sold"))


def dish_stock_flags(menu: DataFrame, items: DataFrame, ing: DataFrame) -> DataFrame:
    """A dish is flagged when any ingredient has stock < grams per portion."""
    stock = ing.select(F.col("name").alias("ingredient_name"), "count")
    j = items.join(stock, "ingredient_name", "left")
    short = F.coalesce(F.col("count"), F.lit(0)) < F.col("quantity_grams")
    flags = j.groupBy("dish_id").agg(F.bool_or(short).alias("low_stock"),
                                     F.count_if(short).alias("short_ingredients"))
    m = menu.select(F.col("id").alias("dish_id"), "dish_name")
    out = m.join(flags, "dish_id", "left")
    return out.select("dish_id", "dish_name",
                      F.coalesce("low_stock", F.lit(False)).alias("low_stock"),
                      F.coalesce("short_ingredients", F.lit(0)).alias("short_ingredients"))
