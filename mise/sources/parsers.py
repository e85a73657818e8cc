"""Payload parsers (S4-S10): landed JSON/HTML bodies -> typed rows.

Everything except the HTML parser is ``from_json`` with an explicit schema plus
higher-order array functions, so it runs as Catalyst expressions. Numbers that the
sources may send quoted are declared as strings and ``try_cast`` (ANSI-safe).
The HTML store page (S5) needs a real HTML parser: it runs in ``mapInPandas`` over
Arrow batches with the standard library's ``html.parser`` - one small helper per row.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mise.functions.expr import MONEY, store_price_text
from mise.sources import html_nodes

# The HTML helper travels to the Python workers by value (no package install needed).
cloudpickle.register_pickle_by_value(html_nodes)

# The web domain of each JSON-searchable store.
STORE_DOMAINS = {"Olímpica": "www.olimpica.com", "Carulla": "www.carulla.com", "Éxito": "www.exito.com"}

# ----------------------------------------------------------------- S4 store search JSON
_SELLER = T.StructType([T.StructField("commertialOffer", T.StructType([
    T.StructField("Price", T.StringType())]))])
SEARCH_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("productName", T.StringType()),
    T.StructField("linkText", T.StringType()),
    T.StructField("priceRange", T.StructType([T.StructField("sellingPrice", T.StructType([
        T.StructField("highPrice", T.StringType())]))])),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("sellers", T.ArrayType(_SELLER))]))),
]))


def _truthy_price(x: F.Column) -> F.Column:
    v = x.try_cast(MONEY)
    return F.when(v != 0, v)


def _scrape_day(df: DataFrame, day) -> F.Column:
    """The day of a response: the given one, else its own, else today."""
    own = F.col("fecha_scrape") if "fecha_scrape" in df.columns else F.current_date()
    return (own if day is None else day).cast("date").alias("fecha_scrape")


def parse_store_json(df: DataFrame, day=None) -> DataFrame:
    """The first hit of the page that has both a name and a price.

    price = priceRange.sellingPrice.highPrice, else items[0].sellers[0].commertialOffer.Price;
    names and urls (from linkText) are kept whole. Input columns: ingrediente, supermercado,
    body and, for responses of several days, fecha_scrape (else ``day`` says the day). A malformed
    body yields no row.
    """
    hits = F.from_json("body", SEARCH_SCHEMA)
    domain = F.element_at(F.create_map(*[x for k, v in STORE_DOMAINS.items()
                                         for x in (F.lit(k), F.lit(v))]), F.col("supermercado"))

    def cand(h):
        high = _truthy_price(h["priceRange"]["sellingPrice"]["highPrice"])
        seller = _truthy_price(F.try_element_at(F.try_element_at(h["items"], F.lit(1))["sellers"], F.lit(1))
                               ["commertialOffer"]["Price"])
        return F.struct(F.coalesce(h["productName"], F.lit("")).alias("name"),
                        F.coalesce(high, seller).alias("price"),
                        F.concat(F.lit("https://"), domain, F.lit("/"),
                                 F.coalesce(h["linkText"], F.lit("")), F.lit("/p")).alias("url"))

    ok = F.filter(F.transform(hits, cand), lambda c: c["price"].isNotNull() & (c["name"] != ""))
    # a generator, so that a body is parsed once and not again for the filter and for each column
    out = df.select("ingrediente", "supermercado", _scrape_day(df, day), F.inline(F.slice(ok, 1, 1)))
    return out.select(
        "ingrediente", "supermercado", F.col("name").alias("producto"), F.col("price").alias("precio"),
        F.coalesce("url", F.lit("")).alias("url"), "fecha_scrape")


# ----------------------------------------------------------------- S5 store search HTML
HTML_HITS = T.StructType([
    T.StructField("ingrediente", T.StringType()), T.StructField("supermercado", T.StringType()),
    T.StructField("fecha_scrape", T.DateType()), T.StructField("rank", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("price_text", T.StringType()), T.StructField("link", T.StringType())])


def parse_store_html(df: DataFrame, day=None) -> DataFrame:
    """Product nodes of a store results page; price text by F5; the first node with a name
    and a price wins. Input: ingrediente, supermercado, html and, for pages of several days,
    fecha_scrape."""
    hits = df.select("ingrediente", "supermercado", _scrape_day(df, day), "html").mapInPandas(
        html_nodes.extract_batches, HTML_HITS)
    hits = hits.withColumn("precio", store_price_text("price_text")).filter(
        F.col("precio").isNotNull() & (F.col("precio") != 0) & (F.coalesce("name", F.lit("")) != ""))
    first = hits.groupBy("ingrediente", "supermercado", "fecha_scrape").agg(
        F.min_by(F.struct("name", "precio", "link"), F.col("rank")).alias("h"))
    return first.select(
        "ingrediente", "supermercado", F.col("h.name").alias("producto"),
        F.col("h.precio").alias("precio"),
        F.coalesce("h.link", F.lit("")).alias("url"), "fecha_scrape")


# ----------------------------------------------------------------- S6/S7 catalog
_NAMED = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
PRODUCT_SCHEMA = T.StructType([
    T.StructField("slug", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("prices", T.StructType([T.StructField("price", T.StringType()),
                                          T.StructField("regular_price", T.StringType())])),
    T.StructField("is_in_stock", T.BooleanType()),
    T.StructField("categories", _NAMED), T.StructField("tags", _NAMED)])


def _last_body(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last landed body per key, decided on the texts before they are parsed. ``order``
    is the arrival number or time of a body; there is no order to fall back on."""
    from mise.operators.mutations import latest_per_key
    keyed = df.select(F.get_json_object("body", f"$.{key}").alias("_key"), "body", order)
    return latest_per_key(keyed.filter(F.col("_key").isNotNull()), ["_key"], order)


def _blank_zero(x: F.Column) -> F.Column:
    return F.coalesce(F.nullif(x, F.lit("")).try_cast(MONEY), F.lit(0).cast(MONEY))


def parse_catalog(df: DataFrame, order: str = "arrival") -> DataFrame:
    """One product per body; price and regular_price blank -> 0, in_stock default
    false, category and tag names as arrays; the last body per slug by ``order`` wins."""
    df = _last_body(df, "slug", order)
    p = df.select(F.from_json("body", PRODUCT_SCHEMA).alias("p"),
                  ).filter(F.col("p.slug").isNotNull())
    rows = p.select(
        F.col("p.slug").alias("slug"), F.col("p.name").alias("name"),
        _blank_zero(F.col("p.prices.price")).alias("price"),
        _blank_zero(F.col("p.prices.regular_price")).alias("regular_price"),
        F.coalesce("p.is_in_stock", F.lit(False)).alias("in_stock"),
        F.coalesce(F.transform("p.categories", lambda c: c["name"]), F.array().cast("array<string>"))
        .alias("categories"),
        F.coalesce(F.transform("p.tags", lambda c: c["name"]), F.array().cast("array<string>"))
        .alias("tags"))
    return rows


DETAIL_SCHEMA = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("content", T.StructType([T.StructField("rendered", T.StringType())])),
    T.StructField("excerpt", T.StructType([T.StructField("rendered", T.StringType())]))])


def apply_catalog_details(products: DataFrame, details: DataFrame, order: str = "arrival") -> DataFrame:
    """Description <- content.rendered, variations <- excerpt.rendered, only for
    slugs that are in the catalog (left join from the products); the last body per slug by
    ``order`` wins."""
    last = _last_body(details, "slug", order)
    d = last.select(F.from_json("body", DETAIL_SCHEMA).alias("d")).select(
        F.col("d.slug").alias("slug"), F.coalesce("d.content.rendered", F.lit("")).alias("_desc"),
        F.coalesce("d.excerpt.rendered", F.lit("")).alias("_var")).filter(F.col("slug").isNotNull())
    j = products.join(d, "slug", "left")
    base = [c for c in products.columns if c not in ("description", "variations")]
    old_d = F.col("description") if "description" in products.columns else F.lit(None).cast("string")
    old_v = F.col("variations") if "variations" in products.columns else F.lit(None).cast("string")
    return j.select(*base, F.coalesce("_desc", old_d).alias("description"),
                    F.coalesce("_var", old_v).alias("variations"))


# ----------------------------------------------------------------- S8/S9 orders
LINE_ITEMS = "array<struct<product_id string, name string, quantity string, price string, total string>>"


def parse_orders(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Order header, currency default COP, customer_name = first + ' ' + last (blank
    parts keep the space), line items projected to (product_id, name, quantity, price,
    total) with numeric casts, shipping kept as JSON text; the last body per id by
    ``order`` wins. A body is parsed once, into a variant: the key that decides which body is the
    last and the columns are both taken from it. A malformed body yields no row."""
    from mise.operators.mutations import latest_per_key
    parsed = df.select(F.try_parse_json("body").alias("o"), F.xxhash64("body").alias("_hash"), order)
    keyed = parsed.withColumn("_key", F.try_variant_get("o", "$.id", "string")).filter(F.col("_key").isNotNull())
    o = latest_per_key(keyed, ["_key"], order, tie=["_hash"])

    def text(path: str, default: str | None = "") -> F.Column:
        v = F.try_variant_get("o", f"$.{path}", "string")
        return v if default is None else F.coalesce(v, F.lit(default))

    def money(c: F.Column) -> F.Column:
        return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))

    items = F.transform(F.coalesce(F.try_variant_get("o", "$.line_items", LINE_ITEMS), F.array().cast(LINE_ITEMS)),
                        lambda i: F.struct(
                            i["product_id"].try_cast("bigint").alias("product_id"),
                            i["name"].alias("name"),
                            i["quantity"].try_cast("int").alias("quantity"),
                            money(i["price"]).alias("price"), money(i["total"]).alias("total")))
    shipping = F.try_variant_get("o", "$.shipping", "variant")
    return o.select(
        F.col("_key").try_cast("bigint").alias("id"), text("status").alias("status"),
        text("currency", "COP").alias("currency"), text("date_created", None).alias("date_created"),
        money(text("total", None)).alias("total"),
        F.concat(text("billing.first_name"), F.lit(" "), text("billing.last_name")).alias("customer_name"),
        text("billing.email").alias("customer_email"), text("billing.phone").alias("customer_phone"),
        items.alias("items"),
        F.when(shipping.isNull() | F.is_variant_null(shipping), "{}").otherwise(F.to_json(shipping)).alias("shipping_address"),
        text("payment_method_title").alias("payment_method"), text("payment_status").alias("payment_status"))


def order_lines(orders: DataFrame) -> DataFrame:
    """One row per order item (orders without items keep one NULL row)."""
    x = orders.select(F.col("id").alias("order_id"), "date_created",
                      F.posexplode_outer("items").alias("pos", "item"))
    return x.select("order_id", "date_created", (F.col("pos") + 1).alias("line_no"), "item.*")


# ----------------------------------------------------------------- S10 tickets
TICKET_ITEMS = T.ArrayType(T.StructType([
    T.StructField("dish_id", T.StringType()), T.StructField("quantity", T.StringType()),
    T.StructField("sale_price", T.StringType())]))


def parse_tickets(df: DataFrame) -> DataFrame:
    """Ticket payloads -> lines (ticket_id, line_no, ts, dish_id, quantity default 1,
    optional sale_price). Input: ticket_id, ts, body (JSON array of items). The default is for
    an absent quantity only: one that cannot be read stays NULL and is refused like a
    quantity below 1. Bodies that are no list of items are in ``rejected_tickets``."""
    x = df.select("ticket_id", "ts", F.posexplode(F.from_json("body", TICKET_ITEMS)).alias("pos", "it"))
    return x.select(
        "ticket_id", (F.col("pos") + 1).alias("line_no"), "ts",
        F.col("it.dish_id").try_cast("bigint").alias("dish_id"),
        F.when(F.col("it.quantity").isNull(), F.lit(1)).otherwise(
            F.col("it.quantity").try_cast("int")).alias("quantity"),
        F.col("it.sale_price").try_cast(MONEY).alias("sale_price"))


def rejected_tickets(df: DataFrame) -> DataFrame:
    """(ticket_id, ts, reason) of the payloads that give no line at all."""
    items = F.from_json("body", TICKET_ITEMS)
    reason = F.when(items.isNull(), F.lit("body is not a list of items")).when(
        F.size(items) == 0, F.lit("no items"))
    return df.select("ticket_id", "ts", reason.alias("reason")).filter(F.col("reason").isNotNull())
