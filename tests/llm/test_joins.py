"""Joins of tables that grow with the input: never by a broadcast that the driver builds."""

import random

import pytest

from llm.conftest import SCHEMA, rows_of
from mise.llm import components, minhash, spelling


@pytest.fixture()
def written(monkeypatch):
    """What the modules under test write: (name, frame, plan)."""
    seen = []

    def watch(module):
        def stored(df, name, own=module.stored):
            seen.append((name, df, plan_of(df)))
            return own(df, name)
        monkeypatch.setattr(module, "stored", stored)

    for module in (components, minhash, spelling):
        watch(module)
    return seen


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast(plans):
    return [name for name, plan in plans if "Broadcast" in plan]


def alike(n):
    """Texts that share half of their word pairs, so that they have keys in common but no link."""
    rnd = random.Random(5)
    base = " ".join(f"base{k}" for k in range(60))
    return [(i, base + " " + " ".join(f"own{rnd.randrange(10 ** 6)}" for _ in range(22))) for i in range(n)]


def test_near_duplicates_without_a_broadcast(spark, written):
    docs = spark.createDataFrame(rows_of([*alike(120), (500, alike(1)[0][1] + " more")]), SCHEMA)
    got = minhash.near_duplicates(docs)
    kept = minhash.keep_one(docs)
    plans = [(name, plan) for name, _, plan in written] + [("result", plan_of(got)), ("kept", plan_of(kept))]
    assert not broadcast(plans)
    assert {"large-members", "block-members", "member-texts", "mixed-members"} <= {name for name, _ in plans}
    assert got.filter("kept").count() == kept.count() == 120
    blocks = [df for name, df, _ in written if name == "block-members"]
    members = [df for name, df, _ in written if name == "large-members"]
    # a text's row is repeated for the blocks it meets only after the join
    for rows, large in zip(blocks, members):
        assert rows.count() == large.select("node").distinct().count() > 0
        assert "other" not in rows.columns


def test_spelling_variants_without_a_broadcast(spark, written):
    words = "kitchen kitchan kitchens ingredient ingredents"
    docs = spark.createDataFrame(rows_of([(i, "kitchen ingredient kitchens" if i % 3 else words) for i in range(60)]), SCHEMA)
    got = spelling.variants(docs)
    plans = [(name, plan) for name, _, plan in written] + [("result", plan_of(got))]
    assert not broadcast(plans)
    assert {"words", "variants", "roots"} <= {name for name, _ in plans}
    forms = {r["word"]: r["form"] for r in got.collect()}
    assert forms["kitchan"] == "kitchen" and forms["kitchen"] is None
