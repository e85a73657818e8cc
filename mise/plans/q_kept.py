"""Registered queries over kept tables: stored pages, keyed buckets, sums moved on by changed days,
sales stored for their join, search by index, loads in ledger order, refused rows.

Each query builds its table in a fresh folder of the session's ``spark.checkpoint.dir`` from the
whole test tables, applies the batches that its oracle describes and reads the result back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mise.operators import mutations as M
from mise.operators import paging, prices as PR, text_index
from mise.operators.sales import daily_units
from mise.operators.sales_state import SalesState
from mise.plans import q_inventory, q_projections, q_sales, q_sources  # noqa: F401 - their SQL is reused
from mise.plans.oracle_views import with_views
from mise.plans.registry import REGISTRY, Tables, decimals_as_double, query
from mise.session import scratch_path
from mise.sources import layout, ledger, loaders, parsers, quarantine
from mise.sources.buckets import KeyedTable
from mise.streaming import refusals
from mise.streaming.tickets import TICKET_SCHEMA

HISTORY_START, LAST_30 = q_sales.HISTORY_START, q_sales.LAST_30


def folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def sql_of(name: str) -> str:
    return REGISTRY[name][1]


# ------------------------------------------------------------------- T7
def _stored_pages(spark, sf):
    ing, path = Tables.of(spark, sf).ing, folder(spark, "pages")
    paging.store_pages(ing, ["name"], path)
    return ing, path


@query("t7_stored_page", q_inventory._page_sql(3))
def t7_stored_page(spark, sf):
    ing, path = _stored_pages(spark, sf)
    return decimals_as_double(paging.read_page(spark, path, ing.schema, 3))


@query("t7_stored_page_clamped", q_inventory._page_sql(100000))
def t7_stored_page_clamped(spark, sf):
    ing, path = _stored_pages(spark, sf)
    return decimals_as_double(paging.read_page(spark, path, ing.schema, 100000))


@query("t7_next_page_by_key", with_views("""
SELECT id, category, dish_name, CAST(sale_price AS DOUBLE) AS sale_price FROM menu_board
ORDER BY category DESC NULLS LAST, sale_price NULLS FIRST, id LIMIT 10 OFFSET 40""", "menu_board"))
def t7_next_page_by_key(spark, sf):
    """Five pages in a row by the last row of the one before; the fifth is returned."""
    order = [("category", False), "sale_price", "id"]
    menu, key = Tables.of(spark, sf).menu.select("id", "category", "dish_name", "sale_price"), None
    for _ in range(4):
        key = paging.page_after(menu, order, key).collect()[-1].asDict()
    return decimals_as_double(paging.page_after(menu, order, key))


# ------------------------------------------------------------------- A6 / A7 / G1 kept up
LATE_SALE, CUT, TYPO_DAY = 97, "2000-01-01", "2003-01-01"


def sales_state(spark, sf) -> SalesState:
    """Four batches: the days before ``CUT`` without the sales that come in late, and a day with a
    wrong date; the days since; the days that late sales belong to, whole; the wrong day, empty."""
    t, state = Tables.of(spark, sf), SalesState(spark, folder(spark, "sales-state"), buckets=8)
    heads, day = t.sale_heads, F.to_date("created_at").alias("dia")
    whole = daily_units(heads, t.sale_items, HISTORY_START)
    early, late = F.col("dia") < F.lit(CUT).cast("date"), F.col("id") % LATE_SALE == 0
    on_time = daily_units(heads.filter(~late), t.sale_items, HISTORY_START).filter(early)
    typo = on_time.groupBy("dish_id").agg(F.max("unidades").alias("unidades")).select(
        "dish_id", F.lit(TYPO_DAY).cast("date").alias("dia"), "unidades")
    known = heads.select(day).filter(F.col("dia") >= F.lit(HISTORY_START).cast("date"))
    typo_day = typo.select("dia")
    state.apply_days(on_time.unionByName(typo), known.filter(early).unionByName(typo_day), 0)
    state.apply_days(whole, known.filter(~early), 1)
    state.apply_days(whole, heads.filter(late).select(day).filter(early), 2)
    state.apply_days(whole.limit(0), typo_day, 3)
    return state


@query("g1_forecast_kept", sql_of("g1_forecast"))
def g1_forecast_kept(spark, sf):
    return sales_state(spark, sf).forecast()


@query("a6_daily_units_kept", sql_of("a6_daily_units"))
def a6_daily_units_kept(spark, sf):
    return sales_state(spark, sf).daily_units()


@query("a7_units_kept", sql_of("a7_units_last_30_days"))
def a7_units_kept(spark, sf):
    return sales_state(spark, sf).units_by_dish(LAST_30)


# ------------------------------------------------------------------- R4 / M1
@query("r4_keyed_batches", with_views("""
SELECT id, email, CASE WHEN id % 6 = 0 THEN 'second' WHEN id % 3 = 0 THEN 'first' ELSE role END AS role,
       CASE WHEN id % 10 = 0 THEN 0.0 ELSE CAST(balance AS DOUBLE) END AS balance FROM user_profiles
UNION ALL
SELECT -1 - id, NULL, NULL, 0.0 FROM user_profiles WHERE id % 10 = 0""", "user_profiles"))
def r4_keyed_batches(spark, sf):
    """The profiles as batch 0; batch 1 changes roles, some twice; batch 2 changes balances and
    brings new keys; batch 1 is replayed in between, as after a failure."""
    p = Tables.of(spark, sf).profiles
    table = KeyedTable(spark, folder(spark, "profiles"), p.schema, ["id"], order="seq", buckets=16)
    of = lambda n: F.col("id") % n == 0
    roles = p.filter(of(3)).select("id", F.lit("first").alias("role"), F.lit(1).alias("seq")).unionByName(
        p.filter(of(6)).select("id", F.lit("second").alias("role"), F.lit(2).alias("seq")))
    zero = F.lit(0).cast(p.schema["balance"].dataType).alias("balance")
    balances = p.filter(of(10)).select("id", zero, F.lit(1).alias("seq")).unionByName(
        p.filter(of(10)).select((-1 - F.col("id")).alias("id"), zero, F.lit(1).alias("seq")))
    table.apply_batch(p.withColumn("seq", F.lit(0)), 0)
    table.apply_batch(roles, 1)
    table.apply_batch(roles, 1)
    table.apply_batch(balances, 2)
    table.expire(2)
    return decimals_as_double(table.read())


# ------------------------------------------------------------------- J1
@query("j1_stored_daily_units", sql_of("a6_daily_units"))
def j1_stored_daily_units(spark, sf):
    t, name = Tables.of(spark, sf), f"mise_sales_{uuid.uuid4().hex}"
    layout.store_sales(t.sale_heads, t.sale_items.select("sale_id", "dish_id", "quantity"), name, folder(spark, "sales-layout"))
    return layout.stored_daily_units(spark, name, HISTORY_START)


# ------------------------------------------------------------------- P11 / P13 / P14 by index
def _indexed(spark, df):
    path = folder(spark, "text-index")
    text_index.build(df, path)
    return path


@query("p13_row_search_indexed", sql_of("p13_row_search"))
def p13_row_search_indexed(spark, sf):
    ing = Tables.of(spark, sf).ing
    return decimals_as_double(text_index.search(spark, _indexed(spark, ing), ing.schema, "Brand#1"))


@query("p14_name_search_indexed", sql_of("p14_name_search"))
def p14_name_search_indexed(spark, sf):
    menu = Tables.of(spark, sf).menu.select("id", "dish_name")
    return text_index.count_matches(spark, _indexed(spark, menu), menu.schema, "Widget", ["dish_name"])


# ------------------------------------------------------------------- load order
@query("s3_folder_load", sql_of("s3_ingredient_sheet"))
def s3_folder_load(spark, sf):
    """Two sheets that land in one folder, registered as they come; the later one wins a name."""
    t, root = Tables.of(spark, sf), folder(spark, "sheets")
    for load, sheet in enumerate((q_sources._sheet_rows(t, "b1", lambda pk: pk >= 0, 0),
                                  q_sources._sheet_rows(t, "b2", lambda pk: pk % 7 == 0, 1000))):
        sheet.select(*loaders.INGREDIENT_SHEET).write.mode("append").option("sep", "\t").csv(f"{root}/landed")
        files = ledger.register(spark, f"{root}/ledger", f"{root}/landed", load, "*.csv")
    raw = spark.read.schema(loaders._string_schema(loaders.INGREDIENT_SHEET)).option("sep", "\t").csv(f"{root}/landed")
    out = loaders.parse_ingredients(ledger.in_load_order(raw, files))
    return out.select("name", "classification", "brand", "supplier", "measure",
                      F.col("cost").cast("double").alias("cost"), F.col("count").cast("double").alias("count"))


@query("s7_last_detail", """
SELECT 'p-' || CAST(p_partkey AS VARCHAR) AS slug, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS description,
       '' AS variations FROM part""")
def s7_last_detail(spark, sf):
    """Two bodies a slug; the one that arrived last describes it, whichever that is."""
    t = Tables.of(spark, sf)
    pk = F.col("p_partkey")

    def bodies(text, arrival):
        return t.raw("part").select(F.to_json(F.struct(F.concat(F.lit("p-"), pk.cast("string")).alias("slug"),
                                                       F.struct(F.col(text).alias("rendered")).alias("content"))).alias("body"),
                                    arrival.alias("arrival"))
    details = bodies("p_brand", F.when(pk % 2 == 0, 9).otherwise(1)).unionByName(bodies("p_type", F.lit(5)))
    return parsers.apply_catalog_details(q_sources._catalog(t), details).select("slug", "description", "variations")


@query("m2_last_patch", with_views("""
SELECT id, dish_id, dish_name, CAST(CASE WHEN id % 20 = 0 THEN id % 7 + 2 WHEN id % 30 = 0 THEN 1 ELSE projected_units END AS INTEGER)
  AS projected_units FROM projection_rows""", "projection_rows"))
def m2_last_patch(spark, sf):
    """Several patches of a row, in turn: the last one stays."""
    p = Tables.of(spark, sf).proj_rows
    steps = p.filter(F.col("id") % 20 == 0).select("id", F.explode(F.sequence(F.lit(0), (F.col("id") % 7).cast("int"))).alias("turn"))
    chg = steps.select("id", "turn", (F.col("turn") + 2).cast("int").alias("projected_units")).unionByName(
        p.filter(F.col("id") % 30 == 0).select("id", F.lit(-1).alias("turn"), F.lit(1).alias("projected_units")))
    return M.patch(p, chg, ["id"], ["projected_units"], order="turn", stamp_col=None).select(
        "id", "dish_id", "dish_name", "projected_units")


@query("a22_last_arrival", with_views("""
SELECT ingrediente, supermercado, CAST(arg_max(precio, fecha_scrape) - 1 AS DOUBLE) AS precio, max(fecha_scrape) AS fecha_scrape
FROM precios_competencia GROUP BY 1, 2""", "precios_competencia"))
def a22_last_arrival(spark, sf):
    """Every price is corrected downwards on its day; the correction arrived last."""
    p = Tables.of(spark, sf).prices
    both = p.withColumn("arrival", F.lit(1)).unionByName(
        p.withColumn("precio", (F.col("precio") - 1).cast(p.schema["precio"].dataType)).withColumn("arrival", F.lit(2)))
    return decimals_as_double(PR.price_latest(both, "arrival"))


# ------------------------------------------------------------------- refused rows
def _checked_lines(spark, sf) -> quarantine.Checked:
    li = Tables.of(spark, sf).raw("lineitem")
    bad_price, bad_count = F.col("l_orderkey") % 11 == 0, F.col("l_linenumber") == 3
    export = li.select(
        F.col("l_orderkey").alias("sale_id"), F.col("l_linenumber").alias("line_no"),
        F.when(bad_price, "n/a").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("line_sale"),
        F.when(bad_count, "12,5 kg").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity_grams"))
    typed, checks = quarantine.table_checks(export)
    return quarantine.load_checked(export, typed, checks, folder(spark, "checked"))


@query("s1_checked_rows", """
SELECT l_orderkey AS sale_id, l_linenumber AS line_no, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS line_sale,
       CAST(CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE) AS quantity_grams
FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_linenumber <> 3""")
def s1_checked_rows(spark, sf):
    return decimals_as_double(_checked_lines(spark, sf).good)


@query("s1_refused_rows", """
SELECT l_orderkey AS sale_id, CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END
         AS line_sale,
       concat_ws('; ', CASE WHEN l_orderkey % 11 = 0 THEN 'unreadable line_sale' END,
                 CASE WHEN l_linenumber = 3 THEN 'unreadable quantity_grams' END) AS reasons
FROM lineitem WHERE l_orderkey % 11 = 0 OR l_linenumber = 3""")
def s1_refused_rows(spark, sf):
    refused = _checked_lines(spark, sf).refused
    return refused.select(F.get_json_object("raw", "$.sale_id").cast("bigint").alias("sale_id"),
                          F.get_json_object("raw", "$.line_sale").alias("line_sale"), F.array_join("reasons", "; ").alias("reasons"))


@query("s1_refusal_counts", """
SELECT 'rows' AS what, count(*) AS n FROM lineitem
UNION ALL SELECT 'refused', count(*) FROM lineitem WHERE l_orderkey % 11 = 0 OR l_linenumber = 3
UNION ALL SELECT 'unreadable sale_id', 0 UNION ALL SELECT 'unreadable line_no', 0
UNION ALL SELECT 'unreadable line_sale', count(*) FROM lineitem WHERE l_orderkey % 11 = 0
UNION ALL SELECT 'unreadable quantity_grams', count(*) FROM lineitem WHERE l_linenumber = 3""")
def s1_refusal_counts(spark, sf):
    """The counts that were observed while the rows were written."""
    return spark.createDataFrame(sorted(_checked_lines(spark, sf).counts.items()), "what string, n bigint")


@query("s10_refused_tickets", """
SELECT event_id AS ticket_id, CASE event_id % 5 WHEN 0 THEN 'body is not a list of items' WHEN 1 THEN 'no items'
  WHEN 2 THEN 'quantity < 1' ELSE 'no dish' END AS reasons
FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 4""")
def s10_refused_tickets(spark, sf):
    """Purchases as ticket payloads, four of five kinds of them broken in one way each."""
    e = F.col("event_id")
    dish = F.concat(F.lit('"dish_id": "'), e.cast("string"), F.lit('"'))
    body = (F.when(e % 5 == 0, F.lit("not json")).when(e % 5 == 1, F.lit("[]"))
            .when(e % 5 == 2, F.concat(F.lit("[{"), dish, F.lit('}, {'), dish, F.lit(', "quantity": "0"}]')))
            .when(e % 5 == 3, F.lit('[{"dish_id": "soup", "quantity": "1"}]'))
            .otherwise(F.concat(F.lit("[{"), dish, F.lit(', "quantity": "2"}]'))))
    raw = Tables.of(spark, sf).raw("events").filter("event_type = 'purchase'").select(
        e.alias("ticket_id"), F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))
    checked = quarantine.load_checked(raw, [F.col(c) for c in raw.columns], quarantine.ticket_body_checks(), folder(spark, "tickets"))
    return checked.refused.select(F.get_json_object("raw", "$.ticket_id").cast("bigint").alias("ticket_id"),
                                  F.array_join("reasons", "; ").alias("reasons"))


# ------------------------------------------------------------------- R2 refused lines of a stream
REFUSED_SQL = """
WITH l AS (SELECT event_id - event_id % 3 AS ticket_id, CAST(event_id % 3 AS INTEGER) AS line_no, ts, event_id FROM events
           WHERE event_type = 'purchase'),
m AS (SELECT to_timestamp(avg(epoch(ts)))::TIMESTAMP AS mid FROM l),
h AS (SELECT max(ts) AS newest FROM l, m WHERE ts < mid)"""


def _refusals(spark, sf) -> refusals.Refusals:
    """Two landings of the purchases, before and since their mean time; the second brings every
    seventh line of the first again, and every eleventh line of its own also without a quantity."""
    root = folder(spark, "refusals")
    e = F.col("event_id")
    lines = Tables.of(spark, sf).raw("events").filter("event_type = 'purchase'").select(
        (e - e % 3).alias("ticket_id"), (e % 3).cast("int").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"),
        e.alias("dish_id"), F.lit(1).alias("quantity"))
    mid = lines.select(F.timestamp_seconds(F.avg(F.unix_micros("ts").cast("double")) / 1e6)).scalar()
    first, since = lines.filter(F.col("ts") < mid), lines.filter(F.col("ts") >= mid)
    again = first.filter(F.col("dish_id") % 7 == 0)
    empty = since.filter(F.col("dish_id") % 11 == 0).withColumn("quantity", F.lit(0)).withColumn("line_no", F.lit(9))
    target = refusals.Refusals(spark, f"{root}/lines", buckets=8)
    for landing in (first, since.unionByName(again).unionByName(empty)):
        landing.write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(TICKET_SCHEMA).parquet(f"{root}/landed")
        refusals.refuse_lines(stream, f"{root}/lines", f"{root}/ckpt", buckets=8).awaitTermination()
    return target


@query("r2_refused_lines", REFUSED_SQL + """
SELECT ticket_id, line_no, epoch_us(ts) AS ts_us, CASE WHEN ts < newest - INTERVAL 1 DAY THEN 'late' ELSE 'repeated' END AS reason
FROM l, m, h WHERE ts < mid AND event_id % 7 = 0
UNION ALL SELECT ticket_id, 9, epoch_us(ts), 'quantity < 1' FROM l, m WHERE ts >= mid AND event_id % 11 = 0""")
def r2_refused_lines(spark, sf):
    return _refusals(spark, sf).refused().select("ticket_id", "line_no", F.unix_micros("ts").alias("ts_us"), "reason")


@query("r2_booked_lines", """
SELECT event_id - event_id % 3 AS ticket_id, CAST(event_id % 3 AS INTEGER) AS line_no, epoch_us(ts) AS ts_us, 1 AS quantity
FROM events WHERE event_type = 'purchase'""")
def r2_booked_lines(spark, sf):
    return _refusals(spark, sf).booked().select("ticket_id", "line_no", F.unix_micros("ts").alias("ts_us"), "quantity")


# ------------------------------------------------------------------- K4
@query("k4_run_log", """
SELECT 'orders' AS sync_type, CASE WHEN n = 0 THEN 'error' ELSE 'success' END AS status,
       'supplier ' || CAST(s_suppkey AS VARCHAR) AS message, CAST(n AS INTEGER) AS items_count, s_suppkey * 3600 AS at_s
FROM (SELECT s_suppkey, (SELECT count(*) FROM part WHERE p_partkey % 40 = s_suppkey) AS n FROM supplier) t
ORDER BY s_suppkey DESC LIMIT 20""")
def k4_run_log(spark, sf):
    """A sync run per supplier, an hour apart; runs without items are errors; the newest twenty."""
    from mise.sources import sinks
    t, path = Tables.of(spark, sf), folder(spark, "run-log")
    items = t.raw("part").groupBy((F.col("p_partkey") % 40).alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    runs = t.raw("supplier").join(items, "s_suppkey", "left").select(
        F.lit("orders").alias("sync_type"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("message"),
        F.coalesce("n", F.lit(0)).alias("items_count"), F.timestamp_seconds(F.col("s_suppkey") * 3600).alias("created_at"))
    sinks.log_runs(runs, path, error_when_empty=True)
    return sinks.latest_runs(spark, path).select("sync_type", "status", "message", "items_count",
                                                 F.unix_seconds("created_at").alias("at_s"))
