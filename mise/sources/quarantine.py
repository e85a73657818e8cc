"""M8/S1 rejects in the same pass: one job writes the good rows, the refused ones and the counts.

``load_checked`` tags every row with all reasons against it, writes good and refused rows apart in one
write, and counts rows per reason with ``DataFrame.observe`` while that write runs: the input is
read once. Refused rows keep what was there as JSON text. The result folder is
``accepted=true|false``; a reader of either side prunes the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ROWS, REFUSED = "rows", "refused"


@dataclass
class Checked:
    """A checked load: ``good`` (typed rows), ``refused`` (raw, reasons) and ``counts``."""
    good: DataFrame
    refused: DataFrame
    counts: dict[str, int]


def load_checked(raw: DataFrame, typed: list[Column], checks: list[tuple[str, Column]], path: str) -> Checked:
    """Write ``raw`` under ``path``: rows that pass all ``checks`` (reason, condition that must hold;
    NULL does not hold) as the ``typed`` columns, the others with their reasons.

    ``counts``: rows, refused, and rows against which each reason stands."""
    spark = raw.sparkSession
    names = [c for c, _ in checks]
    if len(set(names)) < len(names):
        raise ValueError("a reason is given twice")
    fails = [~F.coalesce(ok, F.lit(False)) for _, ok in checks]
    reasons = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in zip(names, fails))))
    seen = Observation()
    counted = raw.select("*", reasons.alias("_reasons")).observe(
        seen, F.count(F.lit(1)).alias(ROWS), F.count_if(F.size("_reasons") > 0).alias(REFUSED),
        *(F.count_if(F.array_contains("_reasons", n)).alias(n) for n in names))
    ok = F.size("_reasons") == 0
    out = counted.select(
        *(F.when(ok, c).alias(c_name) for c, c_name in zip(typed, _names(raw, typed))),
        F.when(~ok, F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns)))).alias("_raw"),
        F.when(~ok, F.col("_reasons")).alias("_why"), ok.alias("accepted"))
    out.write.mode("overwrite").partitionBy("accepted").parquet(path)
    rows = spark.read.schema(out.schema).parquet(path)
    good = rows.filter("accepted").drop("_raw", "_why", "accepted")
    refused = rows.filter("NOT accepted").select(F.col("_raw").alias("raw"), F.col("_why").alias("reasons"))
    return Checked(good, refused, {k: int(v) for k, v in seen.get.items()})


def _names(raw: DataFrame, typed: list[Column]) -> list[str]:
    return raw.limit(0).select(*typed).columns


def table_checks(df: DataFrame, name: str | None = None) -> tuple[list[Column], list[tuple[str, Column]]]:
    """The typed columns of an exported table, and that each of its values could be read."""
    from mise.sources.loaders import typed_columns
    columns = typed_columns(df, name)
    return ([c.alias(k) for k, (c, _) in columns.items()],
            [(f"unreadable {k}", ~bad) for k, (c, bad) in columns.items()])


def sheet_checks(product: str, corrupt: str = "_corrupt") -> list[tuple[str, Column]]:
    """A sheet line has its columns and a product name."""
    return [("wrong number of cells", F.col(corrupt).isNull()),
            ("no product", F.trim(F.coalesce(F.col(product), F.lit(""))) != "")]


def ticket_body_checks() -> list[tuple[str, Column]]:
    """A ticket's body is a list of items, and each of them can be sold."""
    from mise.sources.parsers import TICKET_ITEMS
    items = F.from_json("body", TICKET_ITEMS)
    quantity = lambda i: F.when(i["quantity"].isNull(), F.lit(1)).otherwise(i["quantity"].try_cast("int"))
    return [("body is not a list of items", items.isNotNull()),
            ("no items", F.coalesce(F.size(items) > 0, F.lit(True))),
            ("quantity < 1", F.coalesce(F.forall(items, lambda i: F.coalesce(quantity(i) >= 1, F.lit(False))), F.lit(True))),
            ("no dish", F.coalesce(F.forall(items, lambda i: i["dish_id"].try_cast("bigint").isNotNull()), F.lit(True)))]
