"""The dashboard and analytics reads as one job over shared inputs.

The reference fetches the same tables once per panel and recomputes the dish cost in
several routes. Here the panels are lazy DataFrames over shared frames: the
ingredient and menu views and the per-dish costs are persisted once (memory, spilling
to disk) for as long as the job is open, and each panel is one action.

    with Dashboard(spark, sf_dir, as_of) as d:
        for name, df in d.panels().items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mise.operators import costing as C
from mise.operators import inventory as I
from mise.operators import projections as P
from mise.operators import sales as S
from mise.plans.registry import Tables


class Dashboard:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str):
        self.t, self.as_of = Tables.of(spark, sf_dir), as_of
        self._held: list[DataFrame] = []

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._held[-1]

    def __enter__(self) -> "Dashboard":
        self.ing = self._hold(self.t.ing)
        self.menu = self._hold(self.t.menu)
        self.costs = self._hold(C.dish_costs(self.t.items, self.ing))   # used by 3 panels
        return self

    def __exit__(self, *exc) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    def panels(self) -> dict[str, DataFrame]:
        t, ing, menu, costs = self.t, self.ing, self.menu, self.costs
        since = F.trunc(F.lit(self.as_of).cast("date"), "month")
        units = S.units_by_dish(t.sales, t.sale_items, since)
        recipe_costs = (menu.select(F.col("id").alias("dish_id"), "dish_name", "sale_price")
                        .join(costs, "dish_id", "left").join(units, "dish_id", "left")
                        .select(F.col("dish_id").alias("recipe_id"),
                                F.coalesce("dish_name", F.lit("Sin nombre")).alias("recipe_name"),
                                F.coalesce("raw_cost_dec", F.lit(0)).cast("double").alias("cost"),
                                F.coalesce("ingredient_count", F.lit(0)).alias("ingredient_count"),
                                F.coalesce("sale_price", F.lit(0)).cast("double").alias("sale_price"),
                                F.coalesce("units", F.lit(0)).cast("bigint").alias("units_sold")))
        c2 = F.col("cost").cast("decimal(20,2)")
        return {
            # dashboard
            "kpis": I.kpis(ing, menu, t.sales, self.as_of),
            "classification": I.by_class(ing, "null_bucket"),
            "top_costly": I.top_costly(ing),
            "low_stock": I.low_stock_api(ing),
            "margins": I.top_margin(menu),
            "daily_sales": S.daily_rollup_api(t.sales),
            "projections": P.top_projections(t.proj),
            "suppliers": I.by_supplier(ing, "api"),
            # analytics
            "health": I.stock_health(ing),
            "top_value": I.top_value(ing),
            "recipe_costs": recipe_costs,
            "top_recipes": recipe_costs.orderBy(F.desc("cost"), "recipe_id").limit(8),
            "suggested_prices": recipe_costs.select(
                "recipe_id", "cost", F.round(c2 * 2, 2).cast("double").alias("price_2x"),
                F.round(c2 * 3, 2).cast("double").alias("price_3x")),
        }
