"""Inventory reports (A1-A3, A24, A30; P8-P14; T1-T3, T5, T7; W1, W4).

Every report is one scan of the ingredient (or menu) table followed by a hash
aggregate or a top-k (``TakeOrderedAndProject``). The stock-bar maximum is a scalar
subquery, never a one-partition window; the page clamp (T7) takes one row count.
Top-k reports carry a unique tie-break so that results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.functions.expr import (lenient_number, margin_pct, stock_state_fixed,
                                 stock_state_report)


# Dashboard status labels (with their marker emoji).
DASH_LABELS = {"SIN STOCK": "🔴 SIN STOCK", "BAJO": "🟡 BAJO", "OK": "🟢 OK"}
NO_CLASS, NO_SUPPLIER, NO_CATEGORY = "Sin clasificar", "Sin proveedor", "Sin categoria"


def _value() -> F.Column:
    """Inventory value of a row: count x cost (exact decimals)."""
    return F.col("count") * F.col("cost")


def _round0(c) -> F.Column:
    return F.round(c, 0).cast("double")


def by_class(ing: DataFrame, variant: str = "all") -> DataFrame:
    """A1: count and round(sum(count x cost), 0) per classification.

    ``all``: every row (weekly report); ``costed``: cost > 0 (dashboard);
    ``null_bucket``: NULL/'' classification -> 'Sin clasificar', NULLs as 0 (API).
    """
    if variant == "all":
        return ing.groupBy("classification").agg(
            F.count(F.lit(1)).alias("ingredientes"),
            _round0(F.sum(_value())).alias("valor_inventario_actual"))
    if variant == "costed":
        return ing.filter(F.col("cost") > 0).groupBy("classification").agg(
            F.count(F.lit(1)).alias("cantidad"), _round0(F.sum(_value())).alias("valor_total"))
    if variant == "null_bucket":
        cls = F.coalesce(F.nullif(F.col("classification"), F.lit("")), F.lit(NO_CLASS))
        v = F.coalesce(F.col("cost"), F.lit(0)) * F.coalesce(F.col("count"), F.lit(0))
        return ing.groupBy(cls.alias("name")).agg(
            F.count(F.lit(1)).alias("count"), _round0(F.sum(v)).alias("cost"))
    raise ValueError(variant)


def by_supplier(ing: DataFrame, variant: str = "sql", top: int = 10) -> DataFrame:
    """A2: top suppliers by inventory value.

    ``sql``: drops NULL/'' suppliers and cost <= 0; ``api``: NULL/'' -> 'Sin proveedor'.
    """
    if variant == "sql":
        f = ing.filter(F.col("supplier").isNotNull() & (F.col("supplier") != "") & (F.col("cost") > 0))
        g = f.groupBy("supplier").agg(F.count(F.lit(1)).alias("productos"),
                                      _round0(F.sum(_value())).alias("valor_inventario"))
        return g.orderBy(F.desc("valor_inventario"), "supplier").limit(top)
    sup = F.coalesce(F.nullif(F.col("supplier"), F.lit("")), F.lit(NO_SUPPLIER))
    v = F.coalesce(F.col("cost"), F.lit(0)) * F.coalesce(F.col("count"), F.lit(0))
    g = ing.groupBy(sup.alias("name")).agg(F.count(F.lit(1)).alias("count"),
                                          _round0(F.sum(v)).alias("cost"))
    return g.orderBy(F.desc("cost"), "name").limit(top)


def _kpi_rows(df: DataFrame, pairs: list[tuple[str, F.Column]]) -> DataFrame:
    """One aggregate pass over ``df``, unpivoted to (kpi, valor) rows."""
    agg = df.agg(*[c.cast("double").alias(f"k{i}") for i, (_, c) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(f"k{i}").alias("valor"))
                     for i, (n, _) in enumerate(pairs)])
    return agg.select(F.inline(rows))


def kpis(ing: DataFrame, menu: DataFrame, sales: DataFrame, as_of: str) -> DataFrame:
    """A3 + U3: the six dashboard KPIs, one row each; one pass per table."""
    today = F.to_date("created_at") == F.lit(as_of).cast("date")
    return _kpi_rows(ing, [
        ("Valor Total Inventario", F.round(F.sum(F.when(F.col("cost") > 0, _value())), 0)),
        ("Total Ingredientes", F.count(F.lit(1))),
    ]).unionByName(_kpi_rows(menu, [("Platos en Menú", F.count(F.lit(1)))])).unionByName(
        _kpi_rows(sales, [
            ("Ventas Totales", F.round(F.sum("total_sale"), 0)),
            ("Ganancia Neta", F.round(F.sum("total_profit"), 0)),
            ("Ventas Hoy", F.round(F.sum(F.when(today, F.col("total_sale"))), 0)),
        ]))


def low_stock_report(ing: DataFrame) -> DataFrame:
    """P8 report form: rows with count <= min_stock, difference round 2, ascending."""
    return ing.filter(F.col("count") <= F.col("min_stock")).select(
        "name", "measure",
        F.col("count").cast("double").alias("stock_actual"),
        F.col("min_stock").cast("double").alias("min_stock"),
        F.round(F.col("count") - F.col("min_stock"), 2).cast("double").alias("diferencia"),
        stock_state_report("count", "min_stock").alias("estado"))


def low_stock_dashboard(ing: DataFrame, top: int = 30) -> DataFrame:
    """P8 dashboard form: values round 1, labelled state, the 30 lowest differences."""
    state = stock_state_report("count", "min_stock")
    label = (F.when(state == "SIN STOCK", DASH_LABELS["SIN STOCK"])
             .when(state == "BAJO", DASH_LABELS["BAJO"]).otherwise(DASH_LABELS["OK"]))
    out = ing.filter(F.col("count") <= F.col("min_stock")).select(
        "name", "measure",
        F.round("count", 1).cast("double").alias("stock_actual"),
        F.round("min_stock", 1).cast("double").alias("stock_minimo"),
        F.round(F.col("count") - F.col("min_stock"), 1).cast("double").alias("diferencia"),
        label.alias("estado"))
    return out.orderBy("diferencia", "name").limit(top)


def low_stock_api(ing: DataFrame) -> DataFrame:
    """NULLs as 0, count <= min_stock, no limit; badge from count - min."""
    c = F.coalesce(F.col("count"), F.lit(0))
    m = F.coalesce(F.col("min_stock"), F.lit(0))
    return ing.filter(c <= m).select(
        "name", F.coalesce("measure", F.lit("")).alias("measure"),
        c.cast("double").alias("stock"), m.cast("double").alias("min"),
        F.when(c - m < 0, "SIN STOCK").otherwise("BAJO").alias("badge"))


def stock_health(ing: DataFrame) -> DataFrame:
    """P10 + analytics totals: ok/low/out counts with the fixed threshold 5,
    health % = round(100 x ok / total) (0 when empty), total value round 2."""
    c = lenient_number("count", "decimal(12,2)")
    cost = lenient_number("cost", "decimal(12,2)")
    st = stock_state_fixed(c)
    agg = ing.agg(
        F.count(F.lit(1)).alias("ingredient_count"),
        F.round(F.coalesce(F.sum(c * cost), F.lit(0)), 2).cast("double").alias("total_inventory_value"),
        F.count_if(st == "ok").alias("ok"),
        F.count_if(st == "low").alias("low"),
        F.count_if(st == "out").alias("out"))
    pct = F.when(F.col("ingredient_count") == 0, F.lit(0.0)).otherwise(
        F.round(F.col("ok").cast("double") * 100 / F.col("ingredient_count").cast("double"), 0))
    return agg.withColumn("health_pct", pct)


def inventory_filter(ing: DataFrame, search: str, mode: str = "all") -> DataFrame:
    """Case-insensitive name substring AND all / low (count < 5) / ok."""
    hit = F.lower("name").contains(search.lower())
    if mode == "low":
        hit = hit & (F.col("count") < 5)
    elif mode == "ok":
        hit = hit & (F.col("count") >= 5)
    return ing.filter(hit)


def row_totals(ing: DataFrame) -> DataFrame:
    """Count x cost per row, non-numeric -> 0."""
    return ing.select("name", (lenient_number("count", "decimal(12,2)")
                               * lenient_number("cost", "decimal(12,2)")).cast("double").alias("total"))


def row_search(df: DataFrame, term: str) -> DataFrame:
    """Keep rows where any column, as text (NULL as ''), contains ``term``."""
    t = term.lower()
    texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.filter(F.exists(texts, lambda x: F.lower(x).contains(t)))


def name_search_count(df: DataFrame, column: str, term: str) -> DataFrame:
    """P14: 'n of total' for a name search, in one pass."""
    hit = F.lower(F.col(column)).contains(term.lower())
    return df.agg(F.count_if(hit).alias("matches"), F.count(F.lit(1)).alias("total"))


def stock_bar(ing: DataFrame) -> DataFrame:
    """Count / max(max count over the set, 1), capped at 100 %.

    The maximum is a scalar subquery: computed once and broadcast, so no
    one-partition window is needed.
    """
    mx = ing.select(F.greatest(F.max("count"), F.lit(1)).alias("m")).scalar()
    pct = F.least(F.col("count").cast("double") / mx.cast("double") * 100, F.lit(100.0))
    return ing.select("name", F.col("count").cast("double").alias("count"),
                      pct.alias("bar_pct"))


def page(df: DataFrame, order_cols: list, page_no: int, size: int = 10) -> DataFrame:
    """Page N of ``size`` rows, clamped to the last page, with from/to/total.

    The clamp needs the row count: one number comes back to the driver, the
    page itself is a top-k over the sorted set.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    p = min(max(page_no, 1), pages)
    start = (p - 1) * size
    rows = df.orderBy(*order_cols).offset(start).limit(size)
    return rows.select("*", F.lit(p).alias("page"), F.lit(start + 1).alias("from_row"),
                       F.lit(min(start + size, total)).alias("to_row"),
                       F.lit(total).cast("bigint").alias("total"))


def suppliers(ing: DataFrame) -> DataFrame:
    """Trimmed, non-blank, distinct ignoring case; the first in sort order wins."""
    s = ing.filter(F.col("supplier").isNotNull() & (F.trim("supplier") != ""))
    g = s.groupBy(F.lower(F.trim("supplier")).alias("k")).agg(F.min("supplier").alias("first"))
    return g.select(F.trim("first").alias("supplier"))


def top_costly(ing: DataFrame, top: int = 20) -> DataFrame:
    """The most costly ingredients (cost > 0) with their inventory value."""
    return ing.filter(F.col("cost") > 0).orderBy(F.desc("cost"), "name").limit(top).select(
        "name", _round0("cost").alias("costo_unitario"), "measure",
        _round0(_value()).alias("valor_total_inventario"))


def top_value(ing: DataFrame, top: int = 10) -> DataFrame:
    """T5: top ingredients by value = round(count x cost, 2) (analytics)."""
    v = F.round(lenient_number("count", "decimal(12,2)") * lenient_number("cost", "decimal(12,2)"), 2)
    return ing.select("name", v.cast("double").alias("value"),
                      F.col("count").cast("double").alias("count"), "measure"
                      ).orderBy(F.desc("value"), "name").limit(top)


def top_dish_cost(menu: DataFrame, top: int = 20) -> DataFrame:
    """Dishes by stored cost with margin (division guarded, D2)."""
    return menu.filter(F.col("cost_total") > 0).orderBy(F.desc("cost_total"), "id").limit(top).select(
        "dish_name", "category", F.col("cost_total").cast("double").alias("costo_plato"),
        F.col("sale_price").cast("double").alias("sale_price"),
        margin_pct("sale_price", "cost_total").alias("margen_porcentaje"))


def top_margin(menu: DataFrame, top: int = 20) -> DataFrame:
    """T3 (+P17): best margins among dishes with cost > 0 and price > 0."""
    f = menu.filter((F.col("cost_total") > 0) & (F.col("sale_price") > 0)).select(
        "id", "dish_name", _round0("cost_total").alias("costo_plato"),
        _round0("sale_price").alias("precio_venta"),
        _round0(F.col("sale_price") - F.col("cost_total")).alias("ganancia_neta"),
        margin_pct("sale_price", "cost_total").alias("margen_pct"))
    return f.orderBy(F.desc("margen_pct"), "id").limit(top).drop("id")


def category_counts(menu: DataFrame) -> DataFrame:
    """Dishes per category, NULL/'' -> 'Sin categoria'."""
    cat = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(NO_CATEGORY))
    return menu.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("dishes"))


def category_breaks(menu: DataFrame) -> DataFrame:
    """Rows in (category, sort_order, id) order, flagged where the category changes
    (the first row of each category is its header).

    The first row per category is a ``min`` over (sort_order, id) - an aggregate that
    is reduced map-side, so a category holding most of the menu is never sorted in one
    task - joined back on the category (one row per category)."""
    first = menu.groupBy("category").agg(F.min(F.struct("sort_order", "id")).alias("_first"))
    j = menu.join(first, menu.category.eqNullSafe(first.category), "left").drop(first.category)
    return j.select("id", "category", "sort_order",
                    (F.col("_first.id") == F.col("id")).alias("category_header"))
