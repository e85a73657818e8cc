"""Plan checks for every registered query: no cartesian product, no nested-loop join,
no row-at-a-time Python; Python only in the HTML parser (mapInPandas)."""

from __future__ import annotations

import contextlib
import io

import pytest

from conftest import SF_SMALL
from mise.plans.registry import load_all

# streams run when they are built, so they are no plans
QUERIES = {k: fn for k, (fn, _sql) in load_all().items() if not k.startswith(("r1_", "r3_"))}
# the "last per key" rules must not sort whole rows twice around a shuffle
NO_SORT_AGGREGATE = ("m1_", "s6_", "s8_", "s9_", "u1_")
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
PYTHON_ALLOWED = {"s5_store_html": "MapInPandas"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in text, f"{name}: {bad}"
    if "MapInPandas" in text:
        assert PYTHON_ALLOWED.get(name) == "MapInPandas", name
    if name.startswith(NO_SORT_AGGREGATE):
        assert "SortAggregate" not in text, name


def test_scans_are_pruned_and_filtered(spark):
    text = plan_text(QUERIES["a6_daily_units"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text


def test_unused_supplier_is_not_read(spark):
    assert "s_suppkey" not in plan_text(QUERIES["a3_kpis"](spark, SF_SMALL))
    assert "s_suppkey" in plan_text(QUERIES["a24_suppliers"](spark, SF_SMALL))


def test_prices_of_a_small_file_of_many_parts_are_dealt_over_tasks(spark, tmp):
    """Each part becomes up to 12 price rows; one file of parts was one task's work."""
    from mise.sources import adapters as A
    spark.range(60_000).selectExpr("id AS p_partkey", "'Widget' AS p_name", "CAST(id % 900 AS DOUBLE) AS p_retailprice").coalesce(
        1).write.parquet(f"{tmp}/part.parquet")
    prices = A.precios_competencia(spark, tmp)
    assert prices.rdd.getNumPartitions() == 3
    assert prices.count() == 60_000 * 8


def test_a_search_response_is_parsed_once(spark):
    """the parse was repeated for the filter and for each column."""
    text = plan_text(QUERIES["s4_store_json"](spark, SF_SMALL))
    physical = text[text.index("Physical Plan"):]
    assert physical.count("from_json") == 1


def test_real_and_seed_prices_are_not_sorted_before_their_exchange(spark):
    """a scan's task sorted all its rows for the first row of each group."""
    text = plan_text(QUERIES["u1_real_over_seed_merge"](spark, SF_SMALL))
    tree = text[:text.index("\n\n")]
    assert "Sort" not in tree[tree.index("Exchange"):]


def test_kept_sales_do_not_sum_lines_for_a_date(spark):
    """A sale's id and time need none of its lines."""
    from mise.plans.registry import Tables
    t = Tables.of(spark, SF_SMALL)
    assert "l_orderkey" not in plan_text(t.sale_heads)
    assert t.sale_heads.schema == t.sales.select("id", "created_at").schema
    assert sorted(t.sale_heads.collect()) == sorted(t.sales.select("id", "created_at").collect())
