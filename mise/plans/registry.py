"""Query registry: name -> (Spark query, oracle SQL or None).

Each Spark query takes (spark, sf_dir) and returns a DataFrame; the SQL twin is written
independently from the rule text and runs in DuckDB over the raw test tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from mise.sources import adapters as A

AS_OF = A.AS_OF

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Report form: decimal columns as double, so every engine prints them alike."""
    from pyspark.sql import functions as F
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name)
                       if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def query(name: str, sql: str | None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


class Tables:
    """The adapter views for one (session, folder).

    DataFrames are immutable lazy plans, so each view is built (and analysed) once per
    session and folder and shared by every query that reads it.
    """

    _shared: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        key = (id(spark), sf_dir)
        t = cls._shared.get(key)
        if t is None or t.spark is not spark:
            # views of another (older) session are dropped, not kept alive
            cls._shared = {k: v for k, v in cls._shared.items() if v.spark is spark}
            t = cls._shared[key] = cls(spark, sf_dir)
        return t

    @cached_property
    def ing(self) -> DataFrame:
        return A.ingredient_table(self.spark, self.sf)

    @cached_property
    def menu(self) -> DataFrame:
        return A.menu_board(self.spark, self.sf)

    @cached_property
    def items(self) -> DataFrame:
        return A.menu_recipe_items(self.spark, self.sf)

    @cached_property
    def sale_items(self) -> DataFrame:
        return A.sale_items(self.spark, self.sf)

    @cached_property
    def sales(self) -> DataFrame:
        return A.daily_sales(self.spark, self.sf)

    @cached_property
    def sale_heads(self) -> DataFrame:
        return A.sale_heads(self.spark, self.sf)

    @cached_property
    def proj_rows(self) -> DataFrame:
        return A.projection_rows(self.spark, self.sf)

    @cached_property
    def proj(self) -> DataFrame:
        """``sales_projections``: the base rows re-costed for their units."""
        from mise.operators.projections import recost_projections
        return recost_projections(self.proj_rows, self.items, self.ing)

    @cached_property
    def prices(self) -> DataFrame:
        return A.precios_competencia(self.spark, self.sf)

    @cached_property
    def nut(self) -> DataFrame:
        return A.nutrition_table(self.spark, self.sf)

    @cached_property
    def tickets(self) -> DataFrame:
        return A.ticket_lines(self.spark, self.sf)

    @cached_property
    def tickets_multi(self) -> DataFrame:
        return A.ticket_lines(self.spark, self.sf, multi_line=True)

    @cached_property
    def stock_moves(self) -> DataFrame:
        from mise.operators.stock_moves import event_moves
        events = A.stock_events(A.read(self.spark, self.sf, "events"), A.part_count(self.spark, self.sf))
        return event_moves(events, self.items)

    @cached_property
    def profiles(self) -> DataFrame:
        return A.user_profiles(self.spark, self.sf)

    def raw(self, name: str) -> DataFrame:
        return A.read(self.spark, self.sf, name)


def load_all() -> dict:
    # Importing the query modules fills REGISTRY.
    from mise.plans import (q_costing, q_inventory, q_sales, q_demand,  # noqa: F401
                            q_projections, q_prices, q_mutations, q_sources, q_streaming, q_kept)
    return REGISTRY
