"""Connected components of a link table by least neighbours, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import apart, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b) links, for nodes with links.

    Each round every node points to its least neighbour, if that is smaller; pointers are followed
    to their ends by doubling and the links drawn together to links between the ends. So a round
    reads only what the rounds before have left, not all links again. All sides of a join are
    written tables and none is broadcast, so AQE splits a node with very many links; counts per
    node are partially aggregated.
    """
    edges = stored(links.filter("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), "links")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        ends = pointer_ends(edges.groupBy("b").agg(F.min("a").alias("end")).select(F.col("b").alias("node"), "end"))
        labels = stored(labels.join(apart(ends.withColumnRenamed("node", "component")), "component", "left").select(
            "node", F.coalesce("end", "component").alias("component")), "labels")
        drawn = edges.join(apart(ends.select(F.col("node").alias("b"), F.col("end").alias("y"))), "b").join(
            apart(ends.select(F.col("node").alias("a"), F.col("end").alias("x"))), "a", "left")
        edges = stored(drawn.select(*ordered(F.coalesce("x", "a"), F.col("y"))).filter("a <> b").distinct(), "links")
    return labels


def pointer_ends(pointers: DataFrame) -> DataFrame:
    """(node, end): the end of each chain of pointers (node, end) to smaller nodes."""
    ends = stored(pointers, "pointers")
    while True:
        further = ends.select(F.col("node").alias("end"), F.col("end").alias("further"))
        ends = stored(ends.join(apart(further), "end", "left").select(
            "node", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), "pointers")
        if ends.filter("moved").isEmpty():
            return ends.drop("moved")
        ends = ends.drop("moved")


def ordered(x: F.Column, y: F.Column) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def star_pairs(members: DataFrame, turn: int = 0, near=None) -> DataFrame:
    """(a, b): the members of a key against the key's centre of this turn, across components.

    ``members`` has key, node, component and what ``near`` reads: a function of (column of the
    member, column of the other) that makes the condition for a pair.
    """
    more = [c for c in members.columns if c != "key"]
    centres = stored(members.groupBy("key").agg(F.min(F.struct(
        F.xxhash64(F.lit(turn), "node").alias("h"), *more)).alias("x")).select(
        "key", *(F.col(f"x.{c}").alias(f"o_{c}") for c in more)), "centres")
    condition = F.col("component") != F.col("o_component")
    if near is not None:
        condition &= near(F.col, lambda c: F.col(f"o_{c}"))
    return members.join(apart(centres), "key").filter(condition).select(
        *ordered(F.col("node"), F.col("o_node"))).distinct()


def cross_pairs(members: DataFrame, near=None) -> DataFrame:
    """(a, b): all pairs of a key's members that are in different components.

    The largest component of a key is only met by the others, never by itself, so a group of
    copies costs as many pairs as there are strangers in its keys times its members.
    """
    more = [c for c in members.columns if c != "key"]
    largest = stored(members.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("x"), F.count("*").alias("k")).filter("k > 1").select(
        "key", F.col("x.component").alias("largest")), "largest")
    shared = stored(members.join(largest, "key"), "shared-members")
    strays = stored(shared.filter("component <> largest").select(
        "key", *(F.col(c).alias(f"o_{c}") for c in more)), "strays")
    condition = F.col("component") != F.col("o_component")
    if near is not None:
        condition &= near(F.col, lambda c: F.col(f"o_{c}"))
    return shared.join(strays, "key").filter(condition).select(
        *ordered(F.col("node"), F.col("o_node"))).distinct()


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of keys that hold several components, with their components over links."""
    own = stored(members.drop("component").join(apart(components(links)), "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "labelled")
    mixed = stored(own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter(
        "least < most").select("key"), "mixed-keys")
    return stored(own.join(apart(mixed), "key", "left_semi"), "mixed-members")
