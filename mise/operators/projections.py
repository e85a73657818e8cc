"""Projections and the unit forecast.

Forecast (G1). The reference fits a weekly-seasonal trend model per dish on the
driver. Here the same shape is fitted on the executors with SQL aggregates, grouped
by dish (one shuffle by dish, no Python worker). Per dish over its sales days
(days without sales are absent, not zero): t = days since the first sale day, y =
units, n = days, m = mean(y), d1 = last sale day.

    s, i  = regr_slope(y, t), regr_intercept(y, t)
    e[w]  = mean of y - (s*t + i) over the days with weekday w (0 if never seen)
    f     = sum over h = 1..30 of i + s*(t(d1) + h) + e[weekday(d1 + h)]
    units = greatest(1, round(f)), with f = m * 30 when n < 3 or f is NULL

A dish's series has at most one row per calendar day, so every per-dish group is
bounded by the number of days, whatever the number of sale lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.functions.expr import MONEY, next_month_start
from mise.operators.costing import dish_costs

HORIZON = 30
DEFAULT_UNITS = 30


def _cost_info(items: DataFrame, ing: DataFrame) -> DataFrame:
    """Per recipe key (J8): exact cost sum and grams sum (A18/A19 read both)."""
    c = dish_costs(items, ing, by_recipe_key=True)
    return c.select("dish_id", F.col("raw_cost_dec").alias("unit_cost_dec"),
                    F.col("total_grams").alias("grams"))


def _projection_values(units: F.Column) -> list:
    uc = F.coalesce(F.col("unit_cost_dec"), F.lit(0).cast("decimal(38,2)"))
    grams = F.coalesce(F.col("grams"), F.lit(0))
    return [uc.cast("double").alias("unit_cost"),
            F.round(grams * units, 2).cast("double").alias("estimated_qty"),
            F.round(uc * units, 2).cast("double").alias("estimated_cost")]


def init_projections(menu: DataFrame, items: DataFrame, ing: DataFrame, as_of: str,
                     end=next_month_start) -> DataFrame:
    """One projection per dish: 30 units, unit cost = raw recipe cost, estimates
    and dates (P23: start = as_of, end = first day of the next month, or by another rule
    such as ``thirty_days_on``)."""
    m = menu.select(F.col("id").alias("dish_id"), "dish_name", "category")
    j = m.join(_cost_info(items, ing), "dish_id", "left")
    units = F.lit(DEFAULT_UNITS)
    start = F.lit(as_of).cast("date")
    return j.select("dish_id", "dish_name", F.lit(DEFAULT_UNITS).alias("projected_units"),
                    *_projection_values(units),
                    start.alias("start_date"), end(start).alias("end_date"))


def recost_projections(proj: DataFrame, items: DataFrame, ing: DataFrame) -> DataFrame:
    """Projections with unit cost and estimates recomputed for their units."""
    j = proj.join(_cost_info(items, ing), "dish_id", "left")
    units = F.coalesce(F.col("projected_units"), F.lit(DEFAULT_UNITS))
    return j.select(*[c for c in proj.columns], *_projection_values(units))


def projection_totals(proj: DataFrame) -> DataFrame:
    """Dishes, total units, total cost = sum(unit_cost x units), total kg."""
    cost = F.col("unit_cost").cast(MONEY) * F.col("projected_units")
    return proj.agg(
        F.count(F.lit(1)).alias("dishes"),
        F.coalesce(F.sum("projected_units"), F.lit(0)).cast("bigint").alias("units"),
        F.round(F.coalesce(F.sum(cost), F.lit(0)), 2).cast("double").alias("total_cost"),
        F.round(F.coalesce(F.sum(F.col("estimated_qty").cast("decimal(20,2)")), F.lit(0))
                * F.lit("0.001").cast("decimal(4,3)"), 3).cast("double").alias("total_kg"))


def top_projections(proj: DataFrame, top: int = 20) -> DataFrame:
    """T4 (+P16): active projections by units, with projected cost."""
    a = proj.filter(F.col("is_active"))
    uc = F.col("unit_cost").cast(MONEY)
    return a.orderBy(F.desc("projected_units"), "id").limit(top).select(
        "dish_name", F.round("projected_units", 0).cast("double").alias("unidades_poyectadas"),
        F.round(uc, 0).cast("double").alias("costo_unitario"),
        F.round(uc * F.col("projected_units"), 0).cast("double").alias("costo_total_proyectado"))


def projections_view(proj: DataFrame, menu: DataFrame, items: DataFrame) -> DataFrame:
    """Projection rows with the dish category and recipe line count (0 if none)."""
    from mise.operators.costing import recipe_key
    counts = items.groupBy(recipe_key().alias("dish_id")).agg(
        F.count(F.lit(1)).alias("ingredient_count"))
    cat = menu.select(F.col("id").alias("dish_id"), "category")
    j = proj.join(cat, "dish_id", "left").join(counts, "dish_id", "left")
    return j.select("id", "dish_id", "dish_name", "projected_units", "is_active", "category",
                    F.coalesce("ingredient_count", F.lit(0)).alias("ingredient_count"))


def forecast_units(daily: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """G1: units per dish for the ``horizon`` days after its last sale day.

    ``daily``: dish_id, dia, unidades (A6). Sums per (dish, weekday) over the daily
    series, then per dish over those (at most 7 rows), give everything the model
    needs: daily series -> aggregate -> tiny aggregate -> row arithmetic. No window,
    no re-join, no per-day explode.

    * Least squares from sums. t is the day number; the fit does not depend on where
      t starts, so t = days since 1970-01-01. With integer t and y the sums are exact
      (bigint sums, decimal products), and s = (n*Sty - St*Sy) / (n*Stt - St^2), i = (Sy - s*St) / n.
    * Weekday residual means from per-weekday sums: e[w] = (Sy_w - s*St_w - i*n_w) / n_w.
    * The horizon sum: sum_h i + s*(t1 + h) = horizon*i + s*(horizon*t1 + horizon*(horizon+1)/2),
      plus sum_h e[weekday(d1 + h)] = sum_w c_w * e[w], where c_w counts the horizon days
      on weekday w (full weeks, plus the remaining days after them).
    """
    return forecast_from_sums(weekday_sums(daily), horizon)


def weekday_sums(daily: DataFrame) -> DataFrame:
    """G1, first step: per (dish, weekday) the sums over the daily series that the model needs.
    Sums of disjoint days add up, so they can be kept and moved on by changed days only
    (``operators.sales_state``)."""
    # bigint sums (ANSI mode fails on overflow rather than wrapping); the per-dish
    # products below are widened to decimal(38,0) so that they stay exact.
    t = F.datediff("dia", F.lit("1970-01-01").cast("date")).cast("bigint")
    y = F.col("unidades").cast("bigint")
    # level 1, per (dish, weekday): six sums over the daily series (map-side partial)
    return daily.groupBy("dish_id", F.dayofweek("dia").alias("wd")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("st"), F.sum(y).alias("sy"),
        F.sum(t * t).alias("stt"), F.sum(t * y).alias("sty"), F.max("dia").alias("d1"))


def forecast_from_sums(per_wd: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """G1, second step: the forecast from the sums per (dish, weekday)."""
    # level 2, per dish: at most 7 rows each
    aggs = [F.sum("n").alias("n"), F.sum("st").alias("st"), F.sum("sy").alias("sy"),
            F.sum("stt").alias("stt"), F.sum("sty").alias("sty"), F.max("d1").alias("d1")]
    for w in range(1, 8):
        on = F.col("wd") == w
        aggs += [F.sum(F.when(on, F.col("n"))).alias(f"n{w}"),
                 F.sum(F.when(on, F.col("sy"))).alias(f"sy{w}"),
                 F.sum(F.when(on, F.col("st"))).alias(f"st{w}")]
    g = (per_wd.groupBy("dish_id").agg(*aggs)
         .withColumn("m", F.col("sy").cast("double") / F.col("n")))

    def dec(c):
        return F.col(c).cast("decimal(38,0)")
    den = dec("n") * dec("stt") - dec("st") * dec("st")
    s = F.when(den != 0, (dec("n") * dec("sty") - dec("st") * dec("sy")).cast("double")
               / den.cast("double"))
    g = g.withColumn("s", s).withColumn(
        "i", (F.col("sy").cast("double") - F.col("s") * F.col("st").cast("double")) / F.col("n"))
    t1 = F.datediff("d1", F.lit("1970-01-01").cast("date")).cast("double")
    trend = horizon * F.col("i") + F.col("s") * (horizon * t1 + horizon * (horizon + 1) / 2)
    full_weeks, extra = divmod(horizon, 7)
    season = F.lit(0.0)
    for w in range(1, 8):
        e_w = F.when(F.coalesce(F.col(f"n{w}"), F.lit(0)) > 0, (F.col(f"sy{w}").cast("double")
                                          - F.col("s") * F.col(f"st{w}").cast("double")
                                          - F.col("i") * F.col(f"n{w}")) / F.col(f"n{w}"))
        c_w = F.lit(full_weeks)
        for k in range(1, extra + 1):
            c_w = c_w + F.when(F.dayofweek(F.date_add("d1", full_weeks * 7 + k)) == w, 1).otherwise(0)
        season = season + F.coalesce(e_w, F.lit(0.0)) * c_w
    f = trend + season
    units = F.when((F.col("n") < 3) | f.isNull(), F.col("m") * horizon).otherwise(f)
    return g.select("dish_id", F.col("n").alias("sales_days"),
                    F.greatest(F.lit(1), F.round(units, 0).cast("int")).alias("projected_units"))


def apply_forecast(proj: DataFrame, forecast: DataFrame) -> DataFrame:
    """G2 (+J13/U2): new units for every projection row - the forecast when the dish
    has one, else the current units (default 30) floored at 1. Only dishes that have a
    projection row are written (left join from the projections)."""
    f = forecast.select("dish_id", F.col("projected_units").alias("forecast_units"))
    j = proj.join(f, "dish_id", "left")
    keep = F.greatest(F.lit(1), F.coalesce("projected_units", F.lit(DEFAULT_UNITS)))
    return j.select("id", "dish_id", F.col("projected_units").alias("old_units"),
                    F.coalesce("forecast_units", keep).cast("int").alias("projected_units"),
                    F.col("forecast_units").isNotNull().alias("from_forecast"))


def bulk_recost(proj: DataFrame, changes: DataFrame, items: DataFrame, ing: DataFrame,
                stamp=None) -> DataFrame:
    """A19 bulk form: only the changed rows (id, dish_id, projected_units) are re-costed
    for their new units and patched onto the projections (M2); the rest is kept."""
    from mise.operators.mutations import patch
    costed = recost_projections(changes.select("id", "dish_id", "projected_units"), items, ing)
    cols = ["projected_units", "unit_cost", "estimated_qty", "estimated_cost"]
    return patch(proj, costed, ["id"], cols, order=None, stamp_col="updated_at", stamp=stamp)
