"""Registered source queries (S1-S11) and text functions.

Payloads are derived from the test tables (to_json, formatted numbers, generated
HTML) and parsed back, so every parser runs over whole tables and its oracle is
the rule applied to the underlying rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mise.functions import expr as X
from mise.sources import loaders as L
from mise.sources import parsers as PS
from mise.sources.adapters import ingredient_name
from mise.plans.oracle_views import with_views
from mise.plans.registry import Tables, decimals_as_double, query

def _dots(x: F.Column) -> F.Column:
    """Integer as Colombian text with thousands dots: 1234567 -> '1.234.567'."""
    return F.regexp_replace(F.format_number(x, 0), ",", ".")


DOTS_SQL = "replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


# ------------------------------------------------------------------- S1
@query("s1_load_sale_lines", with_views("""
SELECT l_orderkey AS sale_id, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS line_sale,
       CAST(CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS DOUBLE)
         AS line_cost,
       CAST(CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE) AS quantity_grams, l_linenumber AS line_no
FROM lineitem"""))
def s1_load_sale_lines(spark, sf):
    li = Tables.of(spark, sf).raw("lineitem")
    export = li.select(
        F.col("l_orderkey").alias("sale_id"), F.col("l_extendedprice").alias("line_sale"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
        .alias("line_cost"),
        F.col("l_quantity").alias("quantity_grams"), F.col("l_linenumber").alias("line_no"))
    typed = L.load_table(export)
    return typed.select("sale_id", *[F.col(c).cast("double").alias(c)
                                     for c in ("line_sale", "line_cost", "quantity_grams")], "line_no")


# ------------------------------------------------------------------- S2 / F1
def _comma(x: F.Column) -> F.Column:
    return F.concat(F.lit(" "), F.regexp_replace(x.cast("string"), r"\.", ","), F.lit(" "))


@query("s2_nutrition_sheet", with_views("""
SELECT ingredient_name, classification, CAST(protein_g AS DOUBLE) AS protein_g, CAST(fat_g AS DOUBLE) AS fat_g,
       CAST(carbs_g AS DOUBLE) AS carbs_g, CAST(fiber_g AS DOUBLE) AS fiber_g,
       CAST(sodium_mg AS DOUBLE) AS sodium_mg, CAST(total_calories AS DOUBLE) AS total_calories,
       CAST(total_calories AS DOUBLE) AS calories_usda, CAST(0 AS DOUBLE) AS calories_fat
FROM nutrition_table
WHERE NOT (CAST(regexp_extract(ingredient_name, '#([0-9]+)$', 1) AS BIGINT) % 9 = 0)""", "nutrition_table"))
def s2_nutrition_sheet(spark, sf):
    """The nutrition table written out as sheet text (decimal commas, padded cells,
    blank products for every 9th part) and read back through the S2 rules."""
    t = Tables.of(spark, sf)
    n = t.nut.withColumn("pk", F.regexp_extract("ingredient_name", r"#(\d+)$", 1).cast("bigint"))
    cells = {"CLASIFICACION": F.concat(F.col("classification"), F.lit("\t")),
             "PRODUCTO": F.when(F.col("pk") % 9 == 0, F.lit("  ")).otherwise(
                 F.concat(F.col("ingredient_name"), F.lit(" "))),
             "Cantidad (g)": F.lit(" 100,0 ")}
    sheet = {"Calorias USDA": "total_calories", "Proteina (g)": "protein_g", "Grasa (g)": "fat_g",
             "Carbohidrato (g)": "carbs_g", "Fibra (g)": "fiber_g", "Sodio (mg)": "sodium_mg",
             "Total Calorias": "total_calories"}
    cols = []
    for h in L.NUTRITION_HEADER:
        if h in cells:
            cols.append(cells[h].alias(h))
        elif h in sheet:
            cols.append(_comma(F.col(sheet[h])).alias(h))
        else:
            cols.append(F.lit("").alias(h))   # blank cell -> 0
    parsed = L.parse_nutrition(n.select(*cols))
    return parsed.select("ingredient_name", "classification",
                         *[F.col(c).cast("double").alias(c) for c in
                           ("protein_g", "fat_g", "carbs_g", "fiber_g", "sodium_mg", "total_calories",
                            "calories_usda", "calories_fat")])


# ------------------------------------------------------------------- S3 / F2 / F3 / F4
def _sheet_rows(t: Tables, batch: str, pk_filter, cost_shift: int):
    part = t.raw("part")
    pk = F.col("p_partkey")
    presentation = F.element_at(F.array(*[F.lit(p) for p in
                                          ("KILO", "FRASCO X 500 ML", "BOLSA X 200 GRAMOS", "LIBRA",
                                           "UNIDAD", "GARRAFA X 5000", "LITRO", "CHAPETA X 25 GRAMOS")]),
                                (F.col("p_size") % 8 + 1).cast("int"))
    cls = F.when(pk % 4 == 0, F.concat(F.lit("PROTEINA - "), F.col("p_type"))).otherwise(F.col("p_type"))
    cost = (F.floor("p_retailprice") * 3 + cost_shift)
    return part.filter(pk_filter(pk)).select(
        cls.alias("classification"),
        F.concat(F.lit(" "), ingredient_name(pk, F.col("p_name")), F.lit(" ")).alias("name"),
        F.col("p_brand").alias("brand"), F.concat(F.lit("SUP "), (pk % 10).cast("string")).alias("supplier"),
        presentation.alias("presentation"),
        F.concat(F.lit(" "), _dots(cost), F.lit(" ")).alias("cost"),
        F.concat(F.lit(" "), _dots((pk * 37) % 5000), F.lit(" ")).alias("qty"),
        F.lit(batch).alias("batch"))


@query("s3_ingredient_sheet", with_views("""
SELECT p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name,
       CASE WHEN p_partkey % 4 = 0 THEN 'Proteína - ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))
            ELSE p_type END AS classification,
       p_brand AS brand, 'SUP ' || CAST(p_partkey % 10 AS VARCHAR) AS supplier,
       CASE p_size % 8 WHEN 0 THEN 'kg' WHEN 1 THEN 'ml' WHEN 2 THEN 'g' WHEN 3 THEN 'lb' WHEN 4 THEN 'u'
                       WHEN 5 THEN 'u' WHEN 6 THEN 'l' ELSE 'g' END AS measure,
       CAST(CAST(floor(p_retailprice) AS BIGINT) * 3 + CASE WHEN p_partkey % 7 = 0 THEN 1000 ELSE 0 END AS DOUBLE) AS cost,
       CAST((p_partkey * 37) % 5000 AS DOUBLE) AS count
FROM part"""))
def s3_ingredient_sheet(spark, sf):
    """Two ingredient sheets (the second re-prices every 7th part) loaded by S3; the
    later batch wins per name."""
    t = Tables.of(spark, sf)
    b1 = _sheet_rows(t, "b1", lambda pk: pk >= 0, 0)
    b2 = _sheet_rows(t, "b2", lambda pk: pk % 7 == 0, 1000)
    out = L.parse_ingredients(b1.unionByName(b2))
    return out.select("name", "classification", "brand", "supplier", "measure",
                      F.col("cost").cast("double").alias("cost"), F.col("count").cast("double").alias("count"))


@query("f3_unit_from_presentation", with_views("""
SELECT name, presentation,
       CASE WHEN presentation IN ('KILO') THEN 'kg' WHEN presentation = 'FRASCO X 500 ML' THEN 'ml'
            WHEN presentation IN ('BOLSA X 200 GRAMOS', 'CHAPETA X 25 G') THEN 'g'
            WHEN presentation = 'LIBRA' THEN 'lb' WHEN presentation = 'LITRO' THEN 'l' ELSE 'u' END AS unit
FROM ingredient_table""", "ingredient_table"))
def f3_unit_from_presentation(spark, sf):
    ing = Tables.of(spark, sf).ing
    return ing.select("name", "presentation", X.unit_from_presentation("presentation").alias("unit"))


# ------------------------------------------------------------------- S4 / S5 / F5
def _slug(x: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", "-"))


@query("s4_store_json", with_views("""
SELECT ingrediente, supermercado, fecha_scrape,
       CASE WHEN length(ingrediente) % 2 = 0 THEN producto || ' B' ELSE producto || ' C' END AS producto,
       CAST(CASE WHEN length(ingrediente) % 2 = 0 THEN precio ELSE precio + 1 END AS DOUBLE) AS precio,
       'https://' || CASE supermercado WHEN 'Olímpica' THEN 'www.olimpica.com' WHEN 'Carulla' THEN 'www.carulla.com'
                                       ELSE 'www.exito.com' END || '/'
         || lower(regexp_replace(producto, '[^A-Za-z0-9]+', '-', 'g'))
         || CASE WHEN length(ingrediente) % 2 = 0 THEN '-b' ELSE '-c' END || '/p' AS url
FROM precios_competencia WHERE supermercado <> 'Makro'""",
                                   "precios_competencia"))
def s4_store_json(spark, sf):
    """Search responses of all days built from the prices (a hit without price, a hit priced
    only by its seller, a hit with a range price; two orders) and parsed by S4."""
    p = Tables.of(spark, sf).prices.filter(F.col("supermercado") != "Makro")
    slug = _slug(F.col("producto"))
    price_txt = F.col("precio").cast("string")
    no_price = F.struct(F.concat("producto", F.lit(" A")).alias("productName"),
                        F.concat(slug, F.lit("-a")).alias("linkText"),
                        F.array().cast("array<string>").alias("items"))
    seller = F.struct(F.concat("producto", F.lit(" B")).alias("productName"),
                      F.concat(slug, F.lit("-b")).alias("linkText"),
                      F.array(F.struct(F.array(F.struct(F.struct(price_txt.alias("Price"))
                                                        .alias("commertialOffer"))).alias("sellers")))
                      .alias("items"))
    ranged = F.struct(F.concat("producto", F.lit(" C")).alias("productName"),
                      F.concat(slug, F.lit("-c")).alias("linkText"),
                      F.struct(F.struct((F.col("precio") + 1).alias("highPrice")).alias("sellingPrice"))
                      .alias("priceRange"))
    even = F.length("ingrediente") % 2 == 0
    body = F.when(even, F.concat(F.lit("["), F.to_json(no_price), F.lit(","), F.to_json(seller),
                                 F.lit(","), F.to_json(ranged), F.lit("]"))).otherwise(
        F.concat(F.lit("["), F.to_json(ranged), F.lit(","), F.to_json(no_price), F.lit(","),
                 F.to_json(seller), F.lit("]")))
    parsed = PS.parse_store_json(p.select("ingrediente", "supermercado", "fecha_scrape", body.alias("body")))
    return parsed.select("ingrediente", "supermercado", "fecha_scrape", "producto",
                         F.col("precio").cast("double").alias("precio"), "url")


@query("s5_store_html", with_views("""
SELECT ingrediente, supermercado, fecha_scrape, producto || ' 2' AS producto, CAST(precio AS DOUBLE) AS precio,
       '/p/' || CAST(length(producto) AS VARCHAR) AS url
FROM precios_competencia WHERE supermercado = 'Makro'""",
                                   "precios_competencia"))
def s5_store_html(spark, sf):
    """Store result pages of all days generated from the Makro prices (a node without price,
    then a priced node with a '$ 1.234,56' price) and parsed by S5."""
    p = Tables.of(spark, sf).prices.filter(F.col("supermercado") == "Makro")
    cents = F.lpad(((F.col("precio") * 100).cast("bigint") % 100).cast("string"), 2, "0")
    price_txt = F.concat(F.lit("$ "), _dots(F.floor("precio")), F.lit(","), cents)
    link = F.concat(F.lit("/p/"), F.length("producto").cast("string"))
    html = F.concat(
        F.lit('<html><body><ol><li class="item product"><a class="product-item-link" href="/x">'),
        F.col("producto"), F.lit(' 1</a><br><img src="/i.png"></li><li class="product-item"><img src="/j.png"><strong class="product name">'
                                 '<a class="product-item-link" href="'),
        link, F.lit('">'), F.col("producto"), F.lit(' 2</a></strong><span class="price">'), price_txt,
        F.lit('</span></li></ol></body></html>'))
    parsed = PS.parse_store_html(p.select("ingrediente", "supermercado", "fecha_scrape", html.alias("html")))
    return parsed.select("ingrediente", "supermercado", "fecha_scrape", "producto",
                         F.col("precio").cast("double").alias("precio"), "url")


# ------------------------------------------------------------------- S6 / S7 / F10
def _catalog_bodies(t: Tables):
    part = t.raw("part")
    pk = F.col("p_partkey")
    price = F.when(pk % 6 == 0, F.lit("")).otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    body = F.to_json(F.struct(
        F.concat(F.lit("p-"), pk.cast("string")).alias("slug"), F.col("p_name").alias("name"),
        F.struct(price.alias("price"), (F.col("p_retailprice").cast("decimal(12,2)") + 100)
                 .cast("string").alias("regular_price")).alias("prices"),
        F.when(pk % 4 != 0, pk % 3 == 0).alias("is_in_stock"),
        F.array(F.struct(F.col("p_type").alias("name"))).alias("categories"),
        F.when(pk % 5 != 0, F.array(F.struct(F.col("p_brand").alias("name")),
                                    F.struct(F.lit("menu").alias("name")))).alias("tags")))
    return part.select(body.alias("body"), pk.alias("arrival"))


CATALOG_SQL = """
SELECT 'p-' || CAST(p_partkey AS VARCHAR) AS slug, p_name AS name,
       CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS DOUBLE) AS price,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) + 100 AS DOUBLE) AS regular_price,
       CASE WHEN p_partkey % 4 = 0 THEN false ELSE p_partkey % 3 = 0 END AS in_stock,
       p_type AS categories,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand || '|menu' END AS tags
FROM part"""


def _catalog(t: Tables):
    c = PS.parse_catalog(_catalog_bodies(t))
    return c


@query("s6_catalog", with_views(CATALOG_SQL))
def s6_catalog(spark, sf):
    c = _catalog(Tables.of(spark, sf))
    return c.select("slug", "name", F.col("price").cast("double").alias("price"),
                    F.col("regular_price").cast("double").alias("regular_price"), "in_stock",
                    F.array_join("categories", "|").alias("categories"),
                    F.array_join("tags", "|").alias("tags"))


@query("s7_catalog_details", with_views("""
SELECT 'p-' || CAST(p_partkey AS VARCHAR) AS slug,
       CASE WHEN p_partkey % 3 = 0 THEN '<p>' || p_name || '</p>' END AS description,
       CASE WHEN p_partkey % 3 = 0 THEN '<em>' || p_brand || '</em>' END AS variations
FROM part"""))
def s7_catalog_details(spark, sf):
    t = Tables.of(spark, sf)
    part = t.raw("part")
    pk = F.col("p_partkey")
    details = part.filter(pk % 3 == 0).select(F.to_json(F.struct(
        F.concat(F.lit("p-"), pk.cast("string")).alias("slug"),
        F.struct(F.concat(F.lit("<p>"), F.col("p_name"), F.lit("</p>")).alias("rendered")).alias("content"),
        F.struct(F.concat(F.lit("<em>"), F.col("p_brand"), F.lit("</em>")).alias("rendered")).alias("excerpt")
    )).alias("body"), pk.alias("arrival"))
    stray = part.filter(pk % 3 == 1).select(F.to_json(F.struct(
        F.concat(F.lit("zz-"), pk.cast("string")).alias("slug"))).alias("body"), pk.alias("arrival"))
    out = PS.apply_catalog_details(_catalog(t), details.unionByName(stray))
    return out.select("slug", "description", "variations")


@query("f10_page_excerpt", """
SELECT page_id, substring(regexp_replace(html, '<[^>]*>', '', 'g'), 1, 120) AS excerpt,
       length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars
FROM pages""")
def f10_page_excerpt(spark, sf):
    pages = Tables.of(spark, sf).raw("pages")
    return pages.select("page_id", X.excerpt("html").alias("excerpt"),
                        F.length(X.strip_tags("html")).cast("bigint").alias("text_chars"))


@query("f10_pg_array", """
SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(txt, '[{}"]', '', 'g'), ','),
                                              lambda x: x <> ''), '|') AS items
FROM (SELECT p_partkey, '{' || p_brand || ',"' || p_type || ' x",,' || p_name || '}' AS txt FROM part) t""")
def f10_pg_array(spark, sf):
    part = Tables.of(spark, sf).raw("part")
    txt = F.concat(F.lit("{"), F.col("p_brand"), F.lit(',"'), F.col("p_type"), F.lit(' x",,'),
                   F.col("p_name"), F.lit("}"))
    return part.select("p_partkey", F.array_join(X.pg_array(txt), "|").alias("items"))


# ------------------------------------------------------------------- S8 / S9
def _order_bodies(t: Tables):
    o = t.raw("orders")
    li = t.raw("lineitem")
    c = t.raw("customer").select("c_custkey", "c_name")
    lines = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_partkey").cast("string").alias("product_id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("price"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("total"))).alias("line_items"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(
        lines, o.o_orderkey == lines.l_orderkey, "left")
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(
        k.alias("id"), F.col("o_orderstatus").alias("status"),
        F.when(k % 5 != 0, F.lit("USD")).alias("currency"),
        F.col("o_orderdate").cast("date").cast("string").alias("date_created"),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("total"),
        F.when(k % 7 != 0, F.struct(F.col("c_name").alias("first_name"),
                                    F.lit("Doe").alias("last_name"))).alias("billing"),
        F.col("line_items"),
        F.struct(F.lit("CO").alias("country")).alias("shipping")))
    return j.select(body.alias("body"), k.alias("arrival"))


def land_orders(spark, sf, path: str) -> None:
    """Write the fixture's order bodies, as a shop's export lands them."""
    _order_bodies(Tables.of(spark, sf)).write.mode("overwrite").parquet(path)


@query("s8_orders", with_views("""
SELECT o.o_orderkey AS id, o.o_orderstatus AS status,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'COP' ELSE 'USD' END AS currency,
       CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total,
       CASE WHEN o.o_orderkey % 7 = 0 THEN ' ' ELSE c.c_name || ' Doe' END AS customer_name,
       (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_items,
       '{"country":"CO"}' AS shipping_address
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""))
def s8_orders(spark, sf):
    return orders_of(_order_bodies(Tables.of(spark, sf)))


def orders_of(bodies):
    """S8 of landed order bodies."""
    o = PS.parse_orders(bodies)
    return o.select("id", "status", "currency", F.col("total").cast("double").alias("total"),
                    "customer_name", F.size("items").cast("bigint").alias("n_items"), "shipping_address")


@query("s9_order_lines", with_views("""
SELECT l_orderkey AS order_id, l_partkey AS product_id, 'part ' || CAST(l_partkey AS VARCHAR) AS name,
       CAST(l_quantity AS INTEGER) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS total
FROM lineitem
UNION ALL
SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""))
def s9_order_lines(spark, sf):
    return order_lines_of(_order_bodies(Tables.of(spark, sf)))


def order_lines_of(bodies):
    """S9 of landed order bodies."""
    lines = PS.order_lines(PS.parse_orders(bodies))
    return lines.select("order_id", "product_id", "name", "quantity",
                        F.col("price").cast("double").alias("price"),
                        F.col("total").cast("double").alias("total"))


# ------------------------------------------------------------------- S10
@query("s10_ticket_payloads", with_views("""
SELECT ticket_id, dish_id, quantity, CAST(NULL AS DOUBLE) AS sale_price FROM ticket_lines_multi""",
                                         "ticket_lines_multi"))
def s10_ticket_payloads(spark, sf):
    t = Tables.of(spark, sf)
    bodies = t.tickets_multi.groupBy("ticket_id").agg(
        F.min("ts").alias("ts"),
        F.to_json(F.collect_list(F.struct(F.col("dish_id").cast("string").alias("dish_id"),
                                          F.col("quantity").cast("string").alias("quantity"))))
        .alias("body"))
    lines = PS.parse_tickets(bodies)
    return lines.select("ticket_id", "dish_id", "quantity", F.col("sale_price").cast("double").alias("sale_price"))


# ------------------------------------------------------------------- S11 / F11
@query("s11_browse_menu", with_views("SELECT * REPLACE (CAST(cost_total AS DOUBLE) AS cost_total, CAST(overhead_cost AS DOUBLE) AS overhead_cost, CAST(sale_price AS DOUBLE) AS sale_price) FROM menu_board", "menu_board"))
def s11_browse_menu(spark, sf):
    t = Tables.of(spark, sf)
    return decimals_as_double(L.browse({"menu_board": t.menu, "ingredient_table": t.ing,
                                        "menu_recipe_items": t.items, "nutrition_table": t.nut},
                                       "menu_board"))


@query("f11_day_of", with_views("""
SELECT id, CAST(created_at AS DATE) AS dia,
       CAST(substring(CAST(CAST(created_at AS DATE) AS VARCHAR), 1, 10) AS DATE) AS dia_from_text
FROM daily_sales""", "daily_sales"))
def f11_day_of(spark, sf):
    s = Tables.of(spark, sf).sales
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    broken = F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit(" (local)"))
    return s.select("id", X.day_of(iso).alias("dia"), X.day_of(broken).alias("dia_from_text"))
