"""Sales rollups and ticket posting (A4-A7, A26-A28; J1, J12; P21, P22).

Scale notes
* Sale headers and sale lines are both facts: J1 is a shuffle join on the sale id
  (AQE splits skewed ids). Rollups aggregate map-side before the shuffle.
* Ticket posting never explodes ticket lines through recipes: lines are first reduced
  to units per dish, and only that (dish-sized) frame meets the recipe table.
* Stock depletion uses the set form of the per-line loop: for grams >= 0,
  max(0, max(0, c - d1) - d2) = max(0, c - d1 - d2), so one SUM and one floor per
  ingredient, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.functions.expr import MONEY, PER_GRAM, day_of, profit_sign
from mise.operators.costing import costed_lines


def _r0(c) -> F.Column:
    return F.round(c, 0).cast("double")


def daily_rollup(sales: DataFrame, day_name: str = "dia") -> DataFrame:
    """A4: per day round(sum) of sale, cost and profit."""
    return sales.groupBy(F.to_date("created_at").alias(day_name)).agg(
        _r0(F.sum("total_sale")).alias("ventas"), _r0(F.sum("total_cost")).alias("costos"),
        _r0(F.sum("total_profit")).alias("ganancia"))


def daily_rollup_newest(sales: DataFrame, n: int = 30) -> DataFrame:
    """A4 dashboard: the newest ``n`` days."""
    return daily_rollup(sales, "fecha").orderBy(F.desc("fecha")).limit(n)


def daily_rollup_api(sales: DataFrame, n: int = 30) -> DataFrame:
    """A4 API: day text by F11, the last ``n`` days in ascending order."""
    g = sales.groupBy(day_of("created_at").cast("string").alias("fecha")).agg(
        _r0(F.sum("total_sale")).alias("ventas"), _r0(F.sum("total_cost")).alias("costos"),
        _r0(F.sum("total_profit")).alias("ganancia"))
    return g.orderBy(F.desc("fecha")).limit(n).orderBy("fecha")


def day_summary(sales: DataFrame, as_of: str) -> DataFrame:
    """A5: totals of the sales at or after the start of ``as_of``."""
    day = sales.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp"))
    return day.agg(
        F.coalesce(F.sum("total_sale"), F.lit(0)).cast("double").alias("total_sale"),
        F.coalesce(F.sum("total_cost"), F.lit(0)).cast("double").alias("total_cost"),
        F.coalesce(F.sum("total_profit"), F.lit(0)).cast("double").alias("total_profit"),
        F.count(F.lit(1)).alias("orders_count"),
        F.coalesce(F.sum("items_count"), F.lit(0)).cast("bigint").alias("items_count"))


def sold_lines(sales: DataFrame, items: DataFrame, since) -> DataFrame:
    """Sale lines joined to their header, headers filtered by date (pushed to the scan)."""
    h = sales.filter(F.col("created_at") >= F.lit(since).cast("timestamp")).select(
        F.col("id").alias("sale_id"), "created_at")
    return items.join(h, "sale_id", "inner")


def daily_units(sales: DataFrame, items: DataFrame, since) -> DataFrame:
    """Units per dish per day since ``since``."""
    return sold_lines(sales, items, since).groupBy(
        "dish_id", F.to_date("created_at").alias("dia")).agg(
        F.sum("quantity").cast("bigint").alias("unidades"))


def units_by_dish(sales: DataFrame, items: DataFrame, since) -> DataFrame:
    """A7 (+J12): units per dish for the sales of a period (semi-join on the sale ids)."""
    ids = sales.filter(F.col("created_at") >= F.lit(since).cast("timestamp")).select(
        F.col("id").alias("sale_id"))
    return items.join(ids, "sale_id", "left_semi").groupBy("dish_id").agg(
        F.sum("quantity").cast("bigint").alias("units"))


def daily_profit_flags(sales: DataFrame) -> DataFrame:
    """P21 per day: profit and its sign."""
    g = sales.groupBy(F.to_date("created_at").alias("dia")).agg(
        F.sum("total_profit").alias("p"))
    return g.select("dia", F.col("p").cast("double").alias("profit"), profit_sign("p").alias("sign"))


# ------------------------------------------------------------------ ticket posting
def dish_unit_costs(menu: DataFrame, items: DataFrame, ing: DataFrame) -> DataFrame:
    """Per dish: name, menu price and cost per unit = round(sum(grams x unit cost) +
    overhead, 2) as in the sale route (recipe lines by dish_id)."""
    raw = costed_lines(items, ing).groupBy("dish_id").agg(
        F.sum("line_cost_exact").alias("raw_exact"))
    m = menu.select(F.col("id").alias("dish_id"), "dish_name", "sale_price", "overhead_cost")
    j = m.join(raw, "dish_id", "left")
    return j.select(
        "dish_id", "dish_name", "sale_price",
        F.round(F.coalesce("raw_exact", F.lit(0).cast(PER_GRAM)) + F.col("overhead_cost"), 2)
        .cast(MONEY).alias("cost_per_unit"))


def price_tickets(tickets: DataFrame, menu: DataFrame, items: DataFrame, ing: DataFrame) -> DataFrame:
    """Priced ticket lines. Lines with quantity < 1 are skipped; a line whose dish
    is unknown is kept with ``dish_found = false`` so that A27 can reject its ticket.

    ``tickets``: ticket_id, line_id, ts, dish_id, quantity[, sale_price].
    """
    t = tickets.filter(F.col("quantity") >= 1)
    if "sale_price" not in t.columns:
        t = t.withColumn("sale_price", F.lit(None).cast(MONEY))
    t = t.withColumnRenamed("sale_price", "price_override")
    d = dish_unit_costs(menu, items, ing)
    j = t.join(d, "dish_id", "left")
    price = F.coalesce(F.col("price_override").cast(MONEY), F.col("sale_price").cast(MONEY),
                       F.lit(0).cast(MONEY))
    qty = F.col("quantity")
    line_sale = F.round(price * qty, 2)
    line_cost = F.round(F.col("cost_per_unit") * qty, 2)
    return j.select(
        "ticket_id", "line_id", "ts", "dish_id", "dish_name", "quantity",
        F.col("dish_name").isNotNull().alias("dish_found"),
        price.cast("double").alias("sale_price_unit"),
        F.col("cost_per_unit").cast("double").alias("cost_per_unit"),
        line_sale.cast("double").alias("line_sale"),
        line_cost.cast("double").alias("line_cost"),
        F.round(line_sale - line_cost, 2).cast("double").alias("line_profit"))


def post_sales(priced: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """Ticket totals; a ticket is accepted when it has a valid line and every valid line
    found its dish. With ``tickets`` (all lines, valid or not) tickets without a valid line
    are in the result, too. Returns all tickets with ``accepted`` and, for accepted ones, the totals."""
    dec = lambda c: F.col(c).cast(MONEY)
    g = priced.groupBy("ticket_id").agg(
        F.min("ts").alias("created_at"),
        F.bool_and("dish_found").alias("all_found"),
        F.round(F.sum(dec("line_sale")), 2).alias("s"),
        F.round(F.sum(dec("line_cost")), 2).alias("c"),
        F.round(F.sum(dec("line_profit")), 2).alias("p"),
        F.sum("quantity").alias("q"))
    if tickets is not None:
        every = tickets.groupBy("ticket_id").agg(F.min("ts").alias("first_ts"))
        g = every.join(g, "ticket_id", "left").withColumn(
            "created_at", F.coalesce("created_at", "first_ts"))
    ok = F.coalesce(F.col("all_found"), F.lit(False))
    return g.select(
        "ticket_id", "created_at", ok.alias("accepted"),
        F.when(ok, F.col("s")).cast("double").alias("total_sale"),
        F.when(ok, F.col("c")).cast("double").alias("total_cost"),
        F.when(ok, F.col("p")).cast("double").alias("total_profit"),
        F.when(ok, F.col("q")).cast("int").alias("items_count"))


def deplete_stock(ing: DataFrame, priced: DataFrame, totals: DataFrame, items: DataFrame) -> DataFrame:
    """New count = max(0, count - sum(grams x units)) for the ingredients of the
    accepted tickets' dishes; untouched ingredients keep their count (D11: only
    accepted tickets deplete)."""
    ok = totals.filter("accepted").select("ticket_id")
    units = (priced.join(ok, "ticket_id", "left_semi")
             .groupBy("dish_id").agg(F.sum("quantity").alias("units")))
    use = (items.join(units, "dish_id", "inner")
           .groupBy("ingredient_name")
           .agg(F.sum(F.col("quantity_grams") * F.col("units")).alias("used")))
    j = ing.join(use, ing.name == use.ingredient_name, "left")
    after = F.when(F.col("used").isNull(), F.col("count")).otherwise(
        F.greatest(F.lit(0), F.col("count") - F.col("used")))
    return j.select(
        "name", F.col("count").cast("double").alias("count_before"),
        F.coalesce("used", F.lit(0)).cast("double").alias("depleted"),
        after.cast(MONEY).cast("double").alias("count_after"))


def post_tickets(tickets: DataFrame, menu: DataFrame, items: DataFrame, ing: DataFrame,
                 materialize: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A26-A28 as one posting job: (priced lines, ticket totals, new stock).

    The priced lines feed both the totals and the depletion. They are written once as a
    reliable checkpoint in the session's shared ``spark.checkpoint.dir``: computed a
    single time, and a lost executor re-reads them instead of re-running the pricing.
    """
    priced = price_tickets(tickets, menu, items, ing)
    if materialize:
        from mise.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(priced.sparkSession)
        priced = priced.checkpoint(eager=True)
    totals = post_sales(priced, tickets)
    return priced, totals, deplete_stock(ing, priced, totals, items)
