"""Competitor prices.

Price snapshots are a fact table (written partitioned by ``fecha_scrape``, K2); the
ingredient table is the dimension. The per-store columns are conditional aggregates
over the four listed stores: one aggregation pass per ingredient, reduced map-side,
before the fact meets the dimension.

Seed prices (G3) need a random factor u in [0, 1). The reference draws it from a
seeded sequence that depends on row order and cannot run in parallel; here u comes
from a hash of the (ingredient, store) key: the first 8 hex digits of SHA-256,
modulo 10^6, scaled to [0, 1) - deterministic, order-free, and the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mise.functions.expr import MONEY, price_cell
from mise.sources.adapters import STORES

# The pivot column name of each store, in the reference's order.
STORE_COLUMNS = ["olimpica", "carulla", "exito", "makro"]


def price_pivot(ing: DataFrame, prices: DataFrame) -> DataFrame:
    """A21 (+J2): per ingredient with cost > 0, round(avg price, 0) per store over all
    dates; stores without rows stay NULL.

    The price fact is aggregated first - one row per ingredient, four conditional
    averages, partially aggregated map-side - and only that ingredient-sized result
    meets the ingredient table (names are unique, D13, so this equals grouping after
    the join)."""
    avgs = prices.groupBy(F.col("ingrediente").alias("name")).agg(*[
        F.avg(F.when(F.col("supermercado") == s, F.col("precio"))).alias(c)
        for s, c in zip(STORES, STORE_COLUMNS)])
    i = ing.filter(F.col("cost") > 0).select("name", "supplier", "cost")
    j = i.join(avgs, "name", "left")
    return j.select(
        F.col("name").alias("ingrediente"), F.col("supplier").alias("proveedor"),
        F.round("cost", 0).cast("double").alias("nuestro_costo"),
        *[F.round(c, 0).cast("double").alias(c) for c in STORE_COLUMNS])


def _lastness(arrival: str | None) -> list[str]:
    """What makes a price the last of its cell (A22, J16): the newest scrape date, of several
    prices of that date the last to arrive, of prices that arrived together the highest."""
    return ["fecha_scrape", *([arrival] if arrival else []), "precio"]


def price_latest(prices: DataFrame, arrival: str | None = None) -> DataFrame:
    """A22 (+W5): the last price per (ingredient, store) by ``_lastness``; ``arrival`` names the
    column that numbers arrivals (a load's ``batch``), if there is one."""
    last = F.max(F.struct(*_lastness(arrival)))
    return prices.groupBy("ingrediente", "supermercado").agg(last.alias("l")).select(
        "ingrediente", "supermercado", F.col("l.precio").alias("precio"),
        F.col("l.fecha_scrape").alias("fecha_scrape"))


def competitor_grid(ing: DataFrame, prices: DataFrame, arrival: str | None = None) -> DataFrame:
    """J16 + P20: one row per priced ingredient (or every ingredient when there are
    no prices at all), our cost, the latest price per store (``_lastness``) and its cell class."""
    # latest price per store in one aggregate: max_by over the store's own rows only
    wide = prices.groupBy("ingrediente").agg(*[
        F.max_by("precio", F.when(F.col("supermercado") == s, F.struct(*_lastness(arrival)))).alias(c)
        for s, c in zip(STORES, STORE_COLUMNS)])
    # the priced names are the keys of ``wide`` (one aggregate of the fact); every
    # ingredient is listed only when there is no price at all (EXISTS subquery)
    priced = wide.withColumnRenamed("ingrediente", "name")
    no_prices = ing.filter(~prices.exists()).select(
        "name", *[F.lit(None).cast(priced.schema[c].dataType).alias(c) for c in STORE_COLUMNS])
    info = ing.select("name", "cost", "measure")
    j = priced.unionByName(no_prices).join(info, "name", "left")
    cost = F.coalesce(F.col("cost"), F.lit(0))
    cols = []
    for c in STORE_COLUMNS:
        cols += [F.col(c).cast("double").alias(c), price_cell(F.col(c), cost).alias(f"{c}_class")]
    return j.select("name", F.coalesce("measure", F.lit("")).alias("measure"),
                    cost.cast("double").alias("nuestro_costo"), *cols)


def store_summary(prices: DataFrame, day: str) -> DataFrame:
    """Per store for one scrape day: products and round(avg price, 0)."""
    d = prices.filter(F.col("fecha_scrape") == F.lit(day).cast("date"))
    return d.groupBy("supermercado").agg(
        F.count(F.lit(1)).alias("productos"),
        F.round(F.avg("precio"), 0).cast("double").alias("precio_promedio"))


def _unit_hash(key: F.Column) -> F.Column:
    """u in [0, 1) with 6 decimals from the key's SHA-256."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return (h % 1000000).cast("decimal(7,0)") * F.lit("0.000001").cast("decimal(7,6)")


def seed_prices(ing: DataFrame, day: str) -> DataFrame:
    """Estimated prices for each ingredient with cost > 0 and each store:
    round(cost x (0.7 + u x 0.8), 0). Stores come from an inline array (no join)."""
    i = ing.filter(F.col("cost") > 0).select("name", "cost", F.explode(
        F.array(*[F.lit(s) for s in STORES])).alias("supermercado"))
    u = _unit_hash(F.concat_ws("|", "name", "supermercado"))
    mult = F.lit("0.7").cast("decimal(2,1)") + u * F.lit("0.8").cast("decimal(2,1)")
    return i.select(
        F.col("name").alias("ingrediente"), "supermercado", F.col("name").alias("producto"),
        F.lit(None).cast("string").alias("presentacion"),
        F.round(F.col("cost") * mult, 0).cast(MONEY).alias("precio"),
        F.lit("").alias("url"), F.lit(day).cast("date").alias("fecha_scrape"))


def real_over_seed(real: DataFrame, seed: DataFrame, use_estimates: bool = True) -> DataFrame:
    """U1 (+J14, W2): one row per (ingredient, store): a real one first, an estimate only for a
    pair without a real one and only if the caller wants estimates. How many real rows there
    are changes nothing. Ties go to the first product name, then the lowest price."""
    cols = real.columns
    both = real.withColumn("_prio", F.lit(0))
    if use_estimates:
        both = both.unionByName(seed.select(*cols).withColumn("_prio", F.lit(1)))
    w = Window.partitionBy("ingrediente", "supermercado").orderBy(
        "_prio", "producto", "precio", F.xxhash64(*cols))
    # dealt first: no sort of a scan's task for the first rows of its groups
    both = both.repartition("ingrediente", "supermercado")
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*cols)


def valid_price_rows(prices: DataFrame) -> DataFrame:
    """M8 for prices: keep rows with a price > 0 (others are rejected)."""
    return prices.filter(F.col("precio") > 0)


def price_edits(edits: DataFrame, day) -> tuple[DataFrame, DataFrame]:
    """M6 (+M8): single price edits (ingrediente, supermercado, precio[, producto]) as
    price rows: product defaults to the ingredient, the row is stamped with ``day``;
    edits with a price <= 0 are rejected. Returns (rows, rejected); the caller merges
    the rows by (ingrediente, supermercado) with M1."""
    from mise.operators.mutations import price_checks, split_valid
    prod = F.col("producto") if "producto" in edits.columns else F.lit(None).cast("string")
    rows = edits.select(
        "ingrediente", "supermercado", F.coalesce(prod, F.col("ingrediente")).alias("producto"),
        F.lit(None).cast("string").alias("presentacion"), F.col("precio").cast(MONEY).alias("precio"),
        F.lit("").alias("url"), F.lit(day).cast("date").alias("fecha_scrape"))
    return split_valid(rows, price_checks())
