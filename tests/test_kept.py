"""Kept tables: pages, buckets, sums, layouts, indexes, ledgers, refusals."""

from __future__ import annotations

import datetime as dt
import os
import random
import re
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mise.operators import paging, projections as P, text_index as TI
from mise.operators.inventory import page, row_search
from mise.operators.sales import daily_units
from mise.operators.sales_state import SalesState
from mise.plans.registry import Tables
from mise.sources import layout, ledger, loaders, parsers, quarantine
from mise.sources.buckets import KeyedTable
from mise.streaming import refusals
from mise.streaming.tickets import TICKET_SCHEMA
from test_plans import plan_text


def rows(df):
    return [tuple(r) for r in df.collect()]


def files_read(df) -> int:
    """Files that the scans of an executed plan opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    todo, n = [plan], 0
    while todo:
        p = todo.pop()
        if hasattr(p, "plan") and "QueryStage" in p.nodeName():
            todo.append(p.plan())
        if p.metrics().contains("numFiles"):
            n += p.metrics().apply("numFiles").value()
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return n


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


# ------------------------------------------------------------------- paging
ROWS = "name string, price double, id int"


def some_rows(n=307):
    rnd = random.Random(2)
    return [(rnd.choice(["a", "b", None, "c"]), rnd.choice([None, 1.5, 2.0, 7.0]), k) for k in range(n)]


@pytest.mark.parametrize("size", [1, 10, 50, 400])
def test_pages_equal_the_merged_order(spark, tmp, size):
    order = [("name", False), "price", "id"]
    df = spark.createDataFrame(some_rows(), ROWS).repartition(4)
    whole = rows(df.orderBy(*paging._sorts(order)))
    paging.store_pages(df, order, f"{tmp}/pages", ranges=6)
    last = -(-len(whole) // size)
    for n in {1, 2, last // 2 + 1, last, last + 5, -3}:
        got = paging.read_page(spark, f"{tmp}/pages", df.schema, n, size).collect()
        at = min(max(n, 1), last)
        assert [tuple(r)[:3] for r in got] == whole[(at - 1) * size:at * size]
        assert {tuple(r)[3:] for r in got} == {(at, (at - 1) * size + 1, min(at * size, 307), 307)}


def test_a_far_page_reads_at_most_two_ranges(spark, tmp):
    df = spark.range(5000).select(F.col("id"), F.format_string("%06d", "id").alias("name"))
    paging.store_pages(df, ["name"], f"{tmp}/pages", ranges=20)
    for n in (1, 260, 10 ** 9):
        got = paging.read_page(spark, f"{tmp}/pages", df.schema, n)
        assert 1 <= files_read(got) <= 2
        assert rows(got) == rows(page(df, ["name"], n))
        text = plan_text(got)
        assert re.search(r"PartitionFilters: \[[^]]*page_range", text) and "GreaterThanOrEqual(page_place" in text


def test_empty_table_has_an_empty_page(spark, tmp):
    df = spark.createDataFrame([], ROWS)
    paging.store_pages(df, ["id"], f"{tmp}/pages", ranges=3)
    assert rows(paging.read_page(spark, f"{tmp}/pages", df.schema, 4)) == []


def test_next_pages_walk_the_whole_order(spark):
    df = spark.createDataFrame(some_rows(83), ROWS).repartition(3).cache()
    for order in (["name", "price", "id"], [("price", False), ("name", True), ("id", False)]):
        whole, got, key = rows(df.orderBy(*paging._sorts(order))), [], None
        while part := paging.page_after(df, order, key, 9).collect():
            got += map(tuple, part)
            key = part[-1].asDict()
        assert got == whole


# ------------------------------------------------------------------- buckets
def test_a_batch_rewrites_only_its_buckets(spark, tmp):
    schema = "id bigint, a string, b string"
    table = KeyedTable(spark, f"{tmp}/t", schema, ["id"], order="seq", buckets=8)
    first = spark.range(100).select("id", F.lit("x").alias("a"), F.lit("y").alias("b"), F.lit(0).alias("seq"))
    assert table.apply_batch(first, 0) == list(range(8))
    before = files(f"{tmp}/t")
    change = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (500, "in", 1)], "id bigint, a string, seq int")
    touched = table.apply_batch(change, 1)
    assert len(touched) <= 2
    after = files(f"{tmp}/t")
    assert all(after[f] == t for f, t in before.items())
    assert all(any(f"bucket={b}/version=1" in f for b in touched) for f in set(after) - set(before))
    got = {r["id"]: (r["a"], r["b"]) for r in table.read().collect()}
    assert got[3] == ("newer", "y") and got[500] == ("in", None) and len(got) == 101
    # a replay of the batch rewrites the same rows, and earlier versions are still there for it
    assert table.apply_batch(change, 1) == touched and {r["id"]: (r["a"], r["b"]) for r in table.read().collect()} == got
    assert {r["id"]: r["a"] for r in table.read(before=1).collect()} == {k: "x" for k in range(100)}
    assert table.expire(1) == 0 and table.expire(2) == len(touched)
    assert {r["id"]: (r["a"], r["b"]) for r in table.read().collect()} == got


def test_an_emptied_bucket_stays_empty(spark, tmp):
    table = KeyedTable(spark, f"{tmp}/t", "id bigint, a string", ["id"], buckets=2)
    table.apply_batch(spark.range(20).select("id", F.lit("x").alias("a")), 0)
    table.replace(table.read(only=[1]).limit(0), [0], 1)
    assert table.read(only=[0]).count() == 0 and table.read().count() == table.read(only=[1]).count() > 0
    assert table.apply_batch(table.read().limit(0), 2) == []
    assert KeyedTable(spark, f"{tmp}/none", "id bigint", ["id"]).read().count() == 0


def test_stream_into_buckets_survives_a_lost_batch(spark, tmp):
    """Two files as two batches; the second batch's versions are lost and its commit undone."""
    src, ckpt = f"{tmp}/src", f"{tmp}/ckpt"
    table = KeyedTable(spark, f"{tmp}/t", "id bigint, a string", ["id"], order="seq", buckets=4)

    def run(k, batch):
        batch.write.mode("append").parquet(src)
        stream = spark.readStream.schema("id bigint, a string, seq int").parquet(src)
        q = stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(table.sink()).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    run(0, spark.range(30).select("id", F.lit("x").alias("a"), F.lit(0).alias("seq")))
    change = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (77, "r", 1)], "id bigint, a string, seq int")
    run(1, change)
    want = sorted(rows(table.read()))
    assert (1, "q") in want and (77, "r") in want and len(want) == 31
    last = max(int(f) for f in os.listdir(f"{ckpt}/commits") if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(f"{ckpt}/commits/{f}"):
            os.unlink(f"{ckpt}/commits/{f}")
    run(2, change.limit(0))
    assert sorted(rows(table.read())) == want


# ------------------------------------------------------------------- sums moved on
def test_a_last_day_that_went_does_not_come_back(spark, tmp):
    state = SalesState(spark, f"{tmp}/state", buckets=1)
    late, early = dt.date(2024, 2, 10), dt.date(2023, 12, 23)       # both Saturdays
    for batch, (day, n) in enumerate([(late, [3]), (late, []), (early, [2])]):
        state.apply_days(spark.createDataFrame([(1, day, x) for x in n], "dish_id bigint, dia date, unidades bigint"),
                         spark.createDataFrame([(day,)], "dia date"), batch)
    assert rows(state.sums_table.read().filter("n > 0").select("n", "d1")) == [(1, early)]


def test_kept_sums_equal_a_recompute(spark, tmp):
    rnd = random.Random(7)
    state, truth = SalesState(spark, f"{tmp}/state", buckets=3), {}
    start = dt.date(2023, 12, 20)
    for batch in range(7):
        days = {start + dt.timedelta(days=rnd.randrange(60)) for _ in range(rnd.randrange(1, 12))}
        if batch == 4:
            days |= {max(d for _, d in truth)}          # the last day of all loses its sales
        for d in days:
            for dish in range(5):
                truth.pop((dish, d), None)
                if rnd.random() < 0.6 and not (batch == 4 and d == max(days)):
                    truth[dish, d] = rnd.randrange(1, 40)
        new = [(dish, d, n) for (dish, d), n in truth.items() if d in days]
        daily = spark.createDataFrame(new, "dish_id bigint, dia date, unidades bigint")
        listed = spark.createDataFrame([(d,) for d in days], "dia date")
        state.apply_days(daily, listed, batch)
        if batch in (2, 5):
            state.apply_days(daily, listed, batch)      # replayed after a failure
        whole = spark.createDataFrame([(a, b, n) for (a, b), n in truth.items()], "dish_id bigint, dia date, unidades bigint")
        assert sorted(rows(state.daily_units())) == sorted(rows(whole))
        kept = state.sums_table.read().filter("n > 0")
        assert sorted(rows(kept.select("dish_id", "wd", "n", "st", "sy", "stt", "sty", "d1"))) == sorted(rows(P.weekday_sums(whole)))
        assert sorted(rows(state.forecast())) == sorted(rows(P.forecast_units(whole)))


def test_a_correction_reads_its_months_only(spark, tmp):
    state = SalesState(spark, f"{tmp}/state", buckets=2)
    days = spark.createDataFrame([(dt.date(2023, m, 5),) for m in range(1, 13)], "dia date")
    state.apply_days(days.select(F.lit(1).cast("bigint").alias("dish_id"), "dia", F.lit(4).cast("bigint").alias("unidades")), days, 0)
    before = files(f"{tmp}/state/daily")
    march = days.filter("month(dia) = 3")
    state.apply_days(march.select(F.lit(1).cast("bigint").alias("dish_id"), "dia", F.lit(9).cast("bigint").alias("unidades")), march, 1)
    new = set(files(f"{tmp}/state/daily")) - set(before)
    assert new and all("bucket=202303/version=1" in f for f in new)
    assert rows(state.units_by_dish("2023-03-01")) == [(1, 9 + 4 * 9)]
    assert all("bucket=2022" not in f for f in state.daily_table.read(only=[202303]).inputFiles())


# ------------------------------------------------------------------- stored joins
def test_stored_sales_join_without_exchange(spark, tmp):
    t = Tables.of(spark, SF_SMALL)
    layout.store_sales(t.sales.select("id", "created_at"), t.sale_items.select("sale_id", "dish_id", "quantity"), "kept_sales",
                       f"{tmp}/sales", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = layout.stored_lines(spark, "kept_sales", "1999-05-01")
        text = plan_text(df)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert text.count("PartitionFilters: [isnotnull(year") == 2 and "year#" in text
        years = {f.split("year=")[1].split("/")[0] for f in df.inputFiles()}
        assert years and min(years) >= "1999"
        assert sorted(rows(layout.stored_daily_units(spark, "kept_sales", "1999-05-01"))) == sorted(
            rows(daily_units(t.sales, t.sale_items, "1999-05-01")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE kept_sales_heads")
        spark.sql("DROP TABLE kept_sales_lines")


# ------------------------------------------------------------------- search by index
@pytest.mark.parametrize("block", [4, 4096])
def test_search_by_index_equals_the_scan(spark, tmp, monkeypatch, block):
    monkeypatch.setattr(TI, "BLOCK", block)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abÁ ñ1") for _ in range(rnd.randrange(9)))
    data = [(k, rnd.choice([None, word(), word() + "Brand"]), word(), rnd.random() * 100) for k in range(200)]
    df = spark.createDataFrame(data, "id int, name string, note string, cost double").repartition(3)
    TI.build(df, f"{tmp}/index", parts=3)
    for term in ("brand", "ab", "aba", "ÁB", "ñ1a", "b a", "zzz", "12", "randb", "Ba ", "aaaa"):
        want = sorted(rows(row_search(df, term)), key=repr)
        assert sorted(rows(TI.search(spark, f"{tmp}/index", df.schema, term)), key=repr) == want
        if len(term) >= 3:
            assert TI.candidates(spark, f"{tmp}/index", term).count() >= len(want)
    only = TI.count_matches(spark, f"{tmp}/index", df.schema, "brand", ["note"]).collect()[0]
    assert tuple(only) == (sum("brand" in r[2].lower() for r in data), 200)


# ------------------------------------------------------------------- load order
def test_files_of_one_folder_load_in_their_order(spark, tmp):
    folder, led = f"{tmp}/landed", f"{tmp}/ledger"
    os.makedirs(folder)

    def land(name, text, at):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{folder}/{name}", (at, at))
    line = "C\t{}\tb\ts\tKILO\t{}\t1\n"
    land("z.tsv", line.format("rice", 1) + line.format("rice", 2), 1_700_000_000)
    land("a.tsv", line.format("rice", 3) + line.format("oil", 4), 1_700_000_100)
    files_ = ledger.register(spark, led, folder, 0)
    assert files_.count() == 2
    land("m.tsv", line.format("oil", 5) + line.format("salt", 6), 1_600_000_000)       # older file, later load
    for _ in range(2):          # a load that failed is registered again
        files_ = ledger.register(spark, led, folder, 1)
    assert sorted(r["load"] for r in files_.collect()) == [0, 0, 1]
    raw = spark.read.schema(loaders._string_schema(loaders.INGREDIENT_SHEET)).option("sep", "\t").csv(folder)
    got = {r["name"]: int(r["cost"]) for r in loaders.parse_ingredients(ledger.in_load_order(raw, files_)).collect()}
    assert got == {"rice": 3, "oil": 5, "salt": 6}
    # without a ledger the modification time decides
    plain = {r["name"]: int(r["cost"]) for r in loaders.read_ingredient_tsv(spark, folder).collect()}
    assert plain == {"rice": 3, "oil": 4, "salt": 6}


def test_the_last_detail_and_patch_win(spark):
    products = spark.createDataFrame([("p", "P")], "slug string, name string")
    bodies = [('{"slug": "p", "content": {"rendered": "%s"}}' % k, n) for k, n in (("b", 2), ("c", 3), ("a", 1))]
    out = parsers.apply_catalog_details(products, spark.createDataFrame(bodies, "body string, arrival int"))
    assert [r["description"] for r in out.collect()] == ["c"]


# ------------------------------------------------------------------- refused rows
def test_refused_rows_and_counts_come_from_one_job(spark, tmp):
    raw = spark.createDataFrame([("1", "10.5"), ("x", "n/a"), ("3", None), ("4", "7")], "id string, cost string")
    typed, checks = quarantine.table_checks(raw)
    checks = [*checks, ("id is no number", F.col("id").try_cast("int").isNotNull())]
    tracker, group = spark.sparkContext.statusTracker(), "checked-load"
    spark.sparkContext.setJobGroup(group, group)
    got = quarantine.load_checked(raw, typed, checks, f"{tmp}/checked")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(tracker.getJobIdsForGroup(group)) == 1
    assert got.counts == {"rows": 4, "refused": 1, "unreadable id": 0, "unreadable cost": 1, "id is no number": 1}
    assert sorted(rows(got.good), key=repr) == sorted([("1", D("10.50")), ("3", None), ("4", D("7.00"))], key=repr)
    assert rows(got.refused) == [('{"id":"x","cost":"n/a"}', ["unreadable cost", "id is no number"])]


def test_sheet_lines_with_other_cells_are_refused(spark, tmp):
    with open(f"{tmp}/sheet.tsv", "w") as f:
        f.write("C\trice\tb\ts\tKILO\t1.000\t5\nC\toil\tb\nC\t \tb\ts\tKILO\t1\t2\nC\tsalt\tb\ts\tLIBRA\t9\t9\textra\n")
    raw = loaders.read_sheet_lines(spark, f"{tmp}/sheet.tsv", loaders.INGREDIENT_SHEET, header=False)
    got = quarantine.load_checked(raw, [F.col(c) for c in loaders.INGREDIENT_SHEET], quarantine.sheet_checks("name"), f"{tmp}/checked")
    assert got.counts == {"rows": 4, "refused": 3, "wrong number of cells": 2, "no product": 1}
    assert [r["name"] for r in loaders.parse_ingredients(got.good).collect()] == ["rice"]


def test_lines_are_booked_once_or_refused(spark, tmp):
    at = lambda day, hour=9: dt.datetime(2024, 1, day, hour)
    target = refusals.Refusals(spark, f"{tmp}/lines", buckets=4)
    batches = [
        [(1, 1, at(1), 5, 2), (1, 2, at(1), 6, 1), (1, 2, at(1), 6, 1), (2, 1, at(2), 5, 0)],
        [(1, 1, at(1), 5, 2), (3, 1, at(5), 7, 1), (4, 1, at(5), None, 1)],
        [(1, 1, at(1), 5, 2), (3, 1, at(5), 7, 1), (5, 1, at(4, 10), 7, 1), (2, 1, at(5), 5, 3)],
        [],
    ]
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, TICKET_SCHEMA)
        target.write(df, k)
        if k == 1:
            target.write(df, k)     # replayed
    assert sorted(r[:2] for r in rows(target.booked())) == [(1, 1), (1, 2), (2, 1), (3, 1), (5, 1)]
    assert Counter(r[:2] + (r[-1],) for r in rows(target.refused())) == Counter([
        (1, 2, "repeated"), (2, 1, "quantity < 1"), (1, 1, "repeated"), (4, 1, "no dish"), (1, 1, "late"), (3, 1, "repeated")])
    # keys that can only come late are forgotten where a batch wrote
    assert {r["ticket_id"] for r in target.seen.read().collect()} >= {3, 5, 2}


def test_orders_are_parsed_once(spark):
    body = ('{"id": 7, "status": "done", "total": "12.50", "billing": {"first_name": "A"}, "shipping": {"b": 1, "a": [2]}, '
            '"line_items": [{"product_id": 3, "name": "x", "quantity": 2, "price": 1.5, "total": "3.00"}]}')
    df = spark.createDataFrame([(body, 1), (body.replace("done", "open"), 2), ("not json", 3), ('{"id": null}', 4), ("[1]", 5),
                                ('{"id": "8", "shipping": null}', 6)], "body string, arrival int")
    out = parsers.parse_orders(df)
    text = plan_text(out)
    assert text.count("parse_json") + text.count("parseJson") <= 2 and "from_json" not in text and "get_json_object" not in text
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {7, 8} and got[7]["status"] == "open" and got[7]["customer_name"] == "A "
    assert [tuple(i) for i in got[7]["items"]] == [(3, "x", 2, D("1.50"), D("3.00"))]
    assert got[8]["items"] == [] and got[8]["currency"] == "COP" and got[8]["shipping_address"] == "{}" and got[8]["total"] == 0


def test_buckets_of_stored_sales_follow_the_lines(spark, tmp, monkeypatch):
    """eight buckets at every size put an ever larger join into one task."""
    monkeypatch.setattr(layout, "ROWS", 10)
    heads = spark.createDataFrame([(k, dt.datetime(2000, 1, 1 + k % 9)) for k in range(60)], "id bigint, created_at timestamp")
    lines = spark.createDataFrame([(k % 60, k % 7, 1) for k in range(120)], "sale_id bigint, dish_id bigint, quantity int")
    try:
        layout.store_sales(heads, lines, "many_buckets", tmp)
        for table in ("many_buckets_heads", "many_buckets_lines"):
            info = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
            assert info["Num Buckets"] == "12"
        got = layout.stored_daily_units(spark, "many_buckets", "2000-01-01")
        assert got.agg(F.sum("unidades")).first()[0] == 120
    finally:
        for table in ("many_buckets_heads", "many_buckets_lines"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
