"""Mutations as batch table functions (M1-M9): (current table, changes) -> new table.

The reference writes one row at a time over REST. Here each mutation is a join plan
over whole tables; the caller writes the result with a sink (K1/K2). Parquet tables
have no MERGE, so upserts are joins.

Skew: "last change per key" is ``row_number() = 1``. Spark keeps one row per key and
task before the shuffle (group limit), so a key with millions of changes sends one row
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(chg: DataFrame, keys: list[str], order: str | list[str] | None = None,
                   tie: list[str] | None = None) -> DataFrame:
    """The last change per key: largest ``order``, a NULL being older than any value;
    equal orders are decided by a hash of the row, so that a rerun gives the same row.
    Without ``order`` only the hash decides. ``tie``: the columns that the hash reads (all others
    by default), for rows with columns that have no hash."""
    orders = [order] if isinstance(order, str) else list(order or [])
    missing = [c for c in orders if c not in chg.columns]
    if missing:
        raise ValueError(f"no order column {missing}")
    rest = [c for c in chg.columns if c not in keys]
    hashed = rest if tie is None else tie
    by_hash = [F.xxhash64(*hashed).desc()] if hashed else [F.lit(0).desc()]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in orders], *by_hash)
    return chg.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").select(
        *keys, *rest)


def upsert(cur: DataFrame, chg: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """M1 "merge-duplicates": a change replaces the columns it supplies on the row with
    the same key, or is inserted; one change per key wins (``latest_per_key``).
    Columns the change does not supply keep their current value (NULL when inserted)."""
    chg = latest_per_key(chg, keys, order)
    if order is not None and order not in cur.columns:
        chg = chg.drop(order)
    supplied = [c for c in chg.columns if c not in keys and c in cur.columns]
    a = cur.withColumn("_in_cur", F.lit(True))
    b = chg.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in supplied]).withColumn(
        "_in_chg", F.lit(True))
    j = a.join(b, keys, "full_outer")
    out = []
    for c in cur.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in supplied:
            out.append(F.when(F.col("_in_chg").isNotNull(), F.col(f"_new_{c}"))
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def patch(cur: DataFrame, chg: DataFrame, keys: list[str], cols: list[str], order: str | None,
          stamp_col: str | None = "updated_at", stamp: Column | None = None) -> DataFrame:
    """M2: matched rows only, only the allowed ``cols`` that the change supplies; set
    ``stamp_col`` on patched rows. Unmatched changes are ignored; of several changes for a
    key the last by ``order`` is used. ``order=None`` says that no key is changed twice."""
    cols = [c for c in cols if c in chg.columns]
    if order is not None:
        chg = latest_per_key(chg.select(*dict.fromkeys([*keys, *cols, order])), keys, order)
    b = chg.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = cur.join(b, keys, "left")
    out = []
    for c in cur.columns:
        if c in cols:
            out.append(F.when(F.col("_hit").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == stamp_col and stamp is not None:
            out.append(F.when(F.col("_hit").isNotNull(), stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    res = j.select(*out)
    if stamp_col and stamp is not None and stamp_col not in cur.columns:
        res = j.select(*out, F.when(F.col("_hit").isNotNull(), stamp).alias(stamp_col))
    return res


def delete_keys(cur: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """M3: rows whose key is in ``gone`` are removed (anti join, never an IN list)."""
    return cur.join(gone.select(*keys), keys, "left_anti")


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """M3 cascade: children keep only rows whose parent still exists."""
    p = parent.select(F.col(parent_key).alias(child_key))
    return child.join(p, child_key, "left_semi")


def replace_children(cur: DataFrame, new: DataFrame, parent_key: str) -> DataFrame:
    """M4: all rows of each parent present in ``new`` are replaced by the new list."""
    parents = new.select(parent_key).distinct()
    return cur.join(parents, parent_key, "left_anti").unionByName(new.select(*cur.columns))


def restore_column(cur: DataFrame, snap: DataFrame, key: str, col: str) -> DataFrame:
    """M5: ``col`` taken from the snapshot where the key is there, else kept."""
    s = snap.select(key, F.col(col).alias("_snap"))
    j = cur.join(s, key, "left")
    return j.select(*[F.coalesce(F.col("_snap"), F.col(c)).alias(c) if c == col else F.col(c)
                      for c in cur.columns])


def rank_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """0-based position of each row inside its ``group``, by ``order`` (unique per group),
    without sorting a whole group in one task.

    Rows are range-partitioned on (group, order), so a hot group is spread over many
    partitions in order; the partition id is stored with a reliable checkpoint (in
    the shared ``spark.checkpoint.dir``). The position is then the row number inside
    (partition, group), plus the number of rows of the group in earlier partitions,
    a running sum over the small (group, partition) count table."""
    from mise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    parts = (df.repartitionByRange(group, order).withColumn("_pid", F.spark_partition_id())
             .checkpoint(eager=True))
    local = parts.withColumn(
        "_lrn", F.row_number().over(Window.partitionBy("_pid", group).orderBy(order)) - 1)
    counts = parts.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # a NULL group is a group of its own
    offsets = offsets.select(F.col(group).alias("_group"), F.col("_pid").alias("_part"), "_off")
    out = local.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_pid") == F.col("_part"))).drop(
        "_group", "_part")
    return out.withColumn("rank_in_group", F.col("_off") + F.col("_lrn")).drop("_pid", "_lrn", "_off")


def append_dishes(menu: DataFrame, new: DataFrame, order_col: str = "id") -> DataFrame:
    """M7: new dishes go to the end of their category: sort_order = max in the
    category + 1 (0 for a new category), then + 0, 1, 2 ... within the batch in
    ``order_col`` order. The batch positions come from ``rank_within`` (no per-category
    window over a whole category); the current maxima are a grouped aggregate."""
    top = menu.groupBy("category").agg(F.max("sort_order").alias("_max"))
    n = rank_within(new, "category", order_col)
    top = top.withColumnRenamed("category", "_category")
    j = n.join(top, F.col("category").eqNullSafe(F.col("_category")), "left").drop("_category")
    start = F.coalesce(F.col("_max") + 1, F.lit(0))
    return (j.withColumn("sort_order", (start + F.col("rank_in_group")).cast("int"))
            .drop("_max", "rank_in_group"))


def split_valid(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """M8: (good, rejected); ``checks`` are (reason, condition that must hold) in order,
    the first failing reason is reported."""
    reason = None
    for why, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, F.lit(why)) if reason is None else reason.when(bad, F.lit(why))
    tagged = df.withColumn("reject_reason", reason)
    good = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = tagged.filter(F.col("reject_reason").isNotNull())
    return good, rejected


def recipe_checks() -> list[tuple[str, Column]]:
    """Recipe line: ingredient name present, quantity > 0."""
    return [("missing ingredient name",
             F.col("ingredient_name").isNotNull() & (F.trim("ingredient_name") != "")),
            ("quantity must be > 0", F.col("quantity_grams") > 0)]


def dish_checks() -> list[tuple[str, Column]]:
    """New dish: category and name present."""
    return [("missing category", F.col("category").isNotNull() & (F.col("category") != "")),
            ("missing dish name", F.col("dish_name").isNotNull() & (F.col("dish_name") != ""))]


def price_checks() -> list[tuple[str, Column]]:
    return [("price must be > 0", F.col("precio") > 0)]


def ticket_checks() -> list[tuple[str, Column]]:
    return [("quantity < 1", F.col("quantity") >= 1)]


# The menu columns copied onto a catalog product by the alignment, with the
# value a product without a dish starts with (created_at: the time of the alignment).
ALIGN_COLUMNS = {"dish_name": "", "category": "General", "sort_order": 0, "status": "activo", "created_at": None,
                 "cost_total": 0, "portion_weight_g": 0, "protein_g": 0, "calories": 0, "carbs_g": 0,
                 "fat_g": 0, "fiber_g": 0, "sodium_mg": 0, "overhead_cost": 0, "sale_price": 0}


def align_catalog(products: DataFrame, menu: DataFrame, now: Column | None = None) -> DataFrame:
    """M9: copy menu columns onto catalog products whose upper(trim(name)) equals the
    dish's upper(trim(dish_name)) (the lowest dish id wins a tie), set
    menu_board_dish_id. A column that the catalog does not have yet starts with its default
    (``now`` for created_at); products without a dish get dish_name = name."""
    cols = [c for c in ALIGN_COLUMNS if c in menu.columns]
    m = menu.select(F.upper(F.trim("dish_name")).alias("_k"), "id", *cols)
    one = m.groupBy("_k").agg(F.min_by(F.struct("id", *cols), F.col("id")).alias("_m")).select(
        "_k", "_m.*")
    p = products.withColumn("_k", F.upper(F.trim("name")))
    j = p.join(one.select("_k", F.col("id").alias("menu_board_dish_id"),
                          *[F.col(c).alias(f"_mb_{c}") for c in cols]), "_k", "left")
    out = [F.col(c) for c in products.columns if c not in cols and c != "menu_board_dish_id"]
    for c in cols:
        start = now if c == "created_at" and now is not None else F.lit(ALIGN_COLUMNS[c])
        cur = F.col(c) if c in products.columns else start.cast(menu.schema[c].dataType)
        v = F.when(F.col("menu_board_dish_id").isNotNull(), F.col(f"_mb_{c}")).otherwise(cur)
        if c == "dish_name":
            v = F.when(v == "", F.col("name")).otherwise(v)
        out.append(v.alias(c))
    return j.select(*out, "menu_board_dish_id")
