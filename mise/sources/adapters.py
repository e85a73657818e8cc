"""Adapter views: the application's tables derived from the TPC-H-like test tables.

The rules (FIXTURES.md part A) use only modulo, case, cast, concat and exact decimal
products, so that an independent SQL engine can build the same rows. Every view is a
lazy DataFrame; column pruning and filters reach the parquet scans.

Scale notes: ``part``/``supplier`` become the dimension tables (ingredients, menu,
recipes, nutrition); ``lineitem``/``orders``/``events`` become the fact tables
(sale lines, sale headers, tickets). No view collects anything; the part row count
used by the recipe view is a scalar subquery evaluated on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mise.functions.expr import MONEY, QTY, UNIT_COST

# The four competitor stores and the three scrape dates of the fixture.
STORES = ["Olímpica", "Carulla", "Éxito", "Makro"]
SCRAPE_DATES = ["2024-01-01", "2024-01-08", "2024-01-15"]

# Presentation text by p_size % 8, and measure by p_partkey % 7.
PRESENTATIONS = ["KILO", "FRASCO X 500 ML", "BOLSA X 200 GRAMOS", "LIBRA", "UNIDAD",
                 "GARRAFA X 5000", "LITRO", "CHAPETA X 25 G"]
MEASURES = ["g", "kg", "ml", "l", "lb", "u", " Unidad "]

AS_OF = "2001-08-01"  # "today" for the fixture's sales history


def dec(text: str, t: str) -> F.Column:
    """An exact decimal literal (``F.lit(0.6)`` would be a double)."""
    return F.lit(text).cast(t)


_READS: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the DataFrame (file listing and footer schema) is reused per session."""
    path = f"{sf_dir}/{name}.parquet"
    hit = _READS.get((id(spark), path))
    if hit is None or hit[0] is not spark:
        for k in [k for k, v in _READS.items() if v[0] is not spark]:
            del _READS[k]   # reads of another (older) session
        hit = _READS[(id(spark), path)] = (spark, spark.read.parquet(path))
    return hit[1]


def _pick(idx: F.Column, values: list[str]) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def ingredient_name(pk: F.Column, p_name: F.Column) -> F.Column:
    return F.concat(p_name, F.lit(" #"), pk.cast("string"))


def ingredient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    # one row per supplier, which drops it from the plan of a query that does not read it
    suppliers = read(spark, sf_dir, "supplier")
    sup = suppliers.groupBy("s_suppkey").agg(F.min("s_name").alias("s_name"))
    own = part.withColumn("own_supplier", pk % suppliers.select(F.count(F.lit(1))).scalar())
    j = own.join(sup, F.col("own_supplier") == sup.s_suppkey, "left")
    return j.select(
        ingredient_name(pk, F.col("p_name")).alias("name"),
        F.when(pk % 17 == 0, 0).when(pk % 13 == 0, pk % 5).when(pk % 97 == 3, -5)
        .otherwise((pk * 37) % 5000).cast(MONEY).alias("count"),
        F.when(pk % 29 == 0, 0).otherwise(F.col("p_retailprice")).cast(MONEY).alias("cost"),
        _pick(pk % 7, MEASURES).alias("measure"),
        F.when(pk % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type"))
        .alias("classification"),
        F.col("p_brand").alias("brand"),
        F.when(pk % 31 == 0, F.lit(None).cast("string")).when(pk % 31 == 1, "")
        .when(pk % 31 == 2, F.concat(F.lit(" "), F.upper("s_name"), F.lit(" ")))
        .otherwise(F.col("s_name")).alias("supplier"),
        _pick(F.col("p_size") % 8, PRESENTATIONS).alias("presentation"),
        F.when(pk % 19 == 0, F.lit(None)).when(pk % 97 == 3, 0).when(pk % 13 == 0, pk % 5)
        .otherwise((pk * 11) % 900).cast(MONEY).alias("min_stock"),
    )


def menu_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        pk.alias("id"),
        F.col("p_type").alias("category"),
        F.concat(F.upper("p_name"), F.lit(" "), pk.cast("string")).alias("dish_name"),
        F.col("p_size").cast("int").alias("sort_order"),
        F.when(pk % 7 == 0, "inactivo").otherwise("activo").alias("status"),
        F.when(pk % 4 == 0, 0).otherwise(1000 + pk % 3000).cast("decimal(10,2)").alias("cost_total"),
        ((pk % 10) * 10).cast("decimal(10,2)").alias("overhead_cost"),
        F.when(pk % 35 == 0, 0).otherwise(1500 + (pk * 13) % 4000).cast("decimal(10,2)")
        .alias("sale_price"),
        F.when(pk % 45 == 0, 0).otherwise(F.col("p_size") * 10).cast("int").alias("portion_weight_g"),
    )


def menu_recipe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    n = part.select(F.count(F.lit(1))).scalar()
    dishes = menu_board(spark, sf_dir).select("id").filter(F.col("id") % 50 != 45)
    lines = dishes.select(
        F.col("id").alias("dish"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("id") % 4)).alias("k"))
    d, k = F.col("dish"), F.col("k")
    lines = lines.withColumn("ref_pk", (d * 7 + k * 13) % n)
    names = part.select(F.col("p_partkey").alias("ref_pk"),
                        ingredient_name(F.col("p_partkey"), F.col("p_name")).alias("ref_name"))
    j = lines.join(names, "ref_pk", "left")
    return j.select(
        (d * 10 + k).alias("id"),
        d.alias("dish_id"),
        F.when((d + k) % 11 == 0, F.lit(0).cast("bigint")).alias("menu_item_id"),
        F.when((d + k) % 41 == 0, "UNKNOWN INGREDIENT").otherwise(F.col("ref_name"))
        .alias("ingredient_name"),
        (1 + (d + k * 31) % 400).cast(QTY).alias("quantity_grams"),
        F.when((d + k) % 4 == 0, F.lit(None).cast(UNIT_COST))
        .when((d + k) % 4 == 1, dec("0", UNIT_COST))
        .when((d + k) % 4 == 2, dec("0.0049", UNIT_COST))
        .otherwise(((d + k) % 50).cast(UNIT_COST) * dec("0.1", "decimal(2,1)"))
        .cast(UNIT_COST).alias("unit_cost"),
    )


def sale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    line_sale = F.col("l_extendedprice").cast(MONEY)
    line_cost = F.round(line_sale * (1 - F.col("l_discount")).cast("decimal(4,2)")
                        * dec("0.6", "decimal(2,1)"), 2).cast(MONEY)
    return li.select(
        F.col("l_orderkey").alias("sale_id"),
        F.col("l_partkey").alias("dish_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        line_sale.alias("line_sale"),
        line_cost.alias("line_cost"),
        (line_sale - line_cost).cast(MONEY).alias("line_profit"),
    )


def sale_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and time of ``daily_sales``, row for row: their totals, sums over all lines, are not needed."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_sale = sale_items(spark, sf_dir).groupBy("sale_id").agg(
        F.sum("line_sale").alias("s"), F.sum("line_cost").alias("c"),
        F.sum("line_profit").alias("p"), F.sum("quantity").alias("q"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = orders.join(per_sale, orders.o_orderkey == per_sale.sale_id, "left")
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.coalesce("s", F.lit(0)).cast(MONEY).alias("total_sale"),
        F.coalesce("c", F.lit(0)).cast(MONEY).alias("total_cost"),
        F.coalesce("p", F.lit(0)).cast(MONEY).alias("total_profit"),
        F.coalesce("q", F.lit(0)).cast("int").alias("items_count"),
    )


def projection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows of ``sales_projections``; costs and estimates come from A19."""
    return menu_board(spark, sf_dir).select(
        F.col("id"), F.col("id").alias("dish_id"), "dish_name",
        (1 + F.col("id") % 60).cast("int").alias("projected_units"),
        (F.col("id") % 6 != 0).alias("is_active"),
    )


def spread(rows: DataFrame, key: str, per_task: int = 25_000) -> DataFrame:
    """The rows dealt over tasks of about ``per_task`` rows, where each is about to become many or to
    cost much: a small file of parts is one or two tasks' otherwise. The count reads the file's footers."""
    tasks = -(-rows.count() // per_task)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def precios_competencia(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey")
    combos = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(d).alias("d"))
                       for s in range(len(STORES)) for d in range(len(SCRAPE_DATES))])
    pk = F.col("p_partkey")
    x = part.select(pk, "p_name", "p_retailprice", F.inline(combos))
    x = x.filter((pk + F.col("s")) % 3 != 0)
    pct = (70 + (pk * 7 + F.col("s") * 3 + F.col("d") * 5) % 80).cast("decimal(5,0)")
    precio = F.round(F.col("p_retailprice").cast(MONEY) * pct * dec("0.01", "decimal(3,2)"), 2)
    name = ingredient_name(pk, F.col("p_name"))
    return x.select(
        name.alias("ingrediente"),
        _pick(F.col("s"), STORES).alias("supermercado"),
        name.alias("producto"),
        F.lit(None).cast("string").alias("presentacion"),
        precio.cast(MONEY).alias("precio"),
        F.lit(None).cast("string").alias("url"),
        _pick(F.col("d"), SCRAPE_DATES).cast("date").alias("fecha_scrape"),
    )


def nutrition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("p_partkey")
    return read(spark, sf_dir, "part").filter(pk % 8 != 0).select(
        ingredient_name(pk, F.col("p_name")).alias("ingredient_name"),
        F.col("p_type").alias("classification"),
        (pk % 40).cast(QTY).alias("protein_g"),
        (pk % 25).cast(QTY).alias("fat_g"),
        (pk % 70).cast(QTY).alias("carbs_g"),
        (pk % 12).cast(QTY).alias("fiber_g"),
        ((pk * 3) % 900).cast(QTY).alias("sodium_mg"),
        ((pk % 40) * 4 + (pk % 25) * 9 + (pk % 70) * 4).cast(QTY).alias("total_calories"),
    )


def dish_of_event(event_id, parts) -> F.Column:
    """Events go round all dishes."""
    return event_id % parts


def part_count(spark: SparkSession, sf_dir: str) -> F.Column:
    return read(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()


def ticket_lines(spark: SparkSession, sf_dir: str, multi_line: bool = False) -> DataFrame:
    """Sale tickets from purchase events: one line per event; ``multi_line`` groups
    three consecutive event ids into one ticket."""
    ev = read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    eid = F.col("event_id")
    tid = (eid - eid % 3) if multi_line else eid
    return ev.select(
        tid.alias("ticket_id"),
        eid.alias("line_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        dish_of_event(eid, part_count(spark, sf_dir)).alias("dish_id"),
        (1 + F.col("user_id") % 4).cast("int").alias("quantity"),
    )


# The fixture's events as stock events.
STOCK_EVENTS = {"purchase": "sale", "signup": "delivery", "error": "count"}


def stock_events(events: DataFrame, parts) -> DataFrame:
    """Sales, deliveries and stock-takes of dishes (``operators.stock_moves``) from an events
    frame or stream; ``parts``: the number of parts."""
    eid = F.col("event_id")
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STOCK_EVENTS.items()))
    return events.filter(F.col("event_type").isin(*STOCK_EVENTS)).select(
        eid.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        dish_of_event(eid, parts).alias("dish_id"), (1 + F.col("user_id") % 4).cast("int").alias("quantity"),
        ((eid * 37) % 5000).cast(MONEY).alias("counted"))


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table for the mutation operators (customer rows)."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.regexp_replace("c_name", r"[^A-Za-z0-9]", "")),
                 F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("role"),
        F.col("c_acctbal").cast(MONEY).alias("balance"),
    )
