"""Table loaders.

* S1 ``load_table`` / ``read_table``: an exported table with the money/quantity columns
  typed as in its table schema (unit costs keep scale 4, D3; DECIMAL(12,2) where no schema
  says otherwise), NaN turned into NULL, no row cap (D4), unreadable values counted.
* S2 ``read_nutrition_tsv``: the nutrition sheet (tab separated, decimal comma).
* S3 ``read_ingredient_tsv``: the ingredient sheet (thousands dots, unit inference).
* S11 ``browse``: the allow-listed tables of the table browser.

All readers take explicit schemas (no inference) and hand back lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mise.functions.expr import (MONEY, QTY, decimal_comma, normalise_class, strip,
                                 thousands_dot, unit_from_presentation)
from mise.operators.mutations import latest_per_key
from mise.schemas import TABLES

# The columns the lakehouse sync casts to DECIMAL(12,2).
DECIMAL_COLS = [
    "count", "cost", "min_stock", "unit_cost", "total_dish_cost",
    "estimated_qty", "estimated_cost", "sale_price", "cost_total",
    "overhead_cost", "total_sale", "total_cost", "total_profit",
    "line_sale", "line_cost", "line_profit", "sale_price_unit",
    "cost_per_unit", "protein_g", "fat_g", "carbs_g", "fiber_g",
    "sodium_mg", "calories", "calories_usda", "calories_protein",
    "calories_fat", "calories_carbs", "total_calories",
    "total_calories_no_fiber", "quantity_grams", "portion_weight_g",
]

# The nutrition sheet header, in file order.
NUTRITION_HEADER = ["CLASIFICACION", "PRODUCTO", "Cantidad (g)", "Calorias USDA", "Proteina (g)",
                    "Grasa (g)", "Carbohidrato (g)", "Fibra (g)", "Sodio (mg)", "Calorias Proteina",
                    "Calorias Grasa", "Calorias Carbohidratos", "Total Calorias",
                    "Total Calorias Sin Fibra"]
# sheet column -> table column ("Cantidad (g)" is not loaded)
NUTRITION_MEASURES = [
    ("Calorias USDA", "calories_usda"), ("Proteina (g)", "protein_g"), ("Grasa (g)", "fat_g"),
    ("Carbohidrato (g)", "carbs_g"), ("Fibra (g)", "fiber_g"), ("Sodio (mg)", "sodium_mg"),
    ("Calorias Proteina", "calories_protein"), ("Calorias Grasa", "calories_fat"),
    ("Calorias Carbohidratos", "calories_carbs"), ("Total Calorias", "total_calories"),
    ("Total Calorias Sin Fibra", "total_calories_no_fiber"),
]

INGREDIENT_SHEET = ["classification", "name", "brand", "supplier", "presentation", "cost", "qty"]

# Tables the browser may show.
BROWSABLE = ["catalog_products", "ingredient_table", "menu_board", "menu_recipe_items",
             "nutrition_table"]


def typed_columns(df: DataFrame, name: str | None) -> dict[str, tuple[F.Column, F.Column]]:
    """Column -> (typed value, whether it had a value that could not be read)."""
    known = {f.name: f.dataType for f in TABLES[name].fields} if name else {}
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        target = known.get(f.name) or (MONEY if f.name in DECIMAL_COLS else None)
        if target is None or f.dataType == target or isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out[f.name] = F.col(f"`{f.name}`"), F.lit(False)
        else:
            typed = c.try_cast(target)
            out[f.name] = typed, c.isNotNull() & typed.isNull()
    return out


def load_table(df: DataFrame, name: str | None = None) -> DataFrame:
    """The columns of an exported table with their types: those of the table schema
    ``name``, else DECIMAL(12,2) for every listed column present; NaN -> NULL first."""
    return df.select(*(c.alias(k) for k, (c, _) in typed_columns(df, name).items()))


def unreadable_values(df: DataFrame, name: str | None = None) -> DataFrame:
    """Per column, how many values ``load_table`` could not read (they are NULL there)."""
    bad = {k: b for k, (_, b) in typed_columns(df, name).items()}
    counts = df.agg(*(F.count_if(b).alias(k) for k, b in bad.items()))
    return counts.select(F.explode(F.map_from_arrays(
        F.array(*map(F.lit, bad)), F.array(*(F.col(f"`{k}`") for k in bad)))).alias("column", "unreadable"))


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A parquet export of the table ``name``, typed by its schema."""
    return load_table(spark.read.parquet(path), name)


def _string_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _sheets(spark: SparkSession, path: str | list[str], columns: list[str], header: bool) -> DataFrame:
    """Sheets in load order, ``batch`` ascending with the place in the list, then (several files
    under one path) by modification time and name, then in the file."""
    out = None
    for k, p in enumerate([path] if isinstance(path, str) else path):
        raw = (spark.read.schema(_string_schema(columns)).option("sep", "\t").option("header", header).csv(p))
        raw = raw.withColumn("batch", F.struct(
            F.lit(k).alias("load"), F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line")))
        out = raw if out is None else out.unionByName(raw)
    return out


def read_sheet_lines(spark: SparkSession, path: str | list[str], columns: list[str], header: bool) -> DataFrame:
    """A sheet's cells as text, and the whole line in ``_corrupt`` where it has more or fewer cells."""
    schema = _string_schema([*columns, "_corrupt"])
    return (spark.read.schema(schema).option("sep", "\t").option("header", header)
            .option("columnNameOfCorruptRecord", "_corrupt").csv(path))


def read_nutrition_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read one or more nutrition sheets; see ``parse_nutrition``."""
    return parse_nutrition(_sheets(spark, path, NUTRITION_HEADER, header=True))


def parse_nutrition(raw: DataFrame) -> DataFrame:
    """S2 rules: product stripped, rows with a blank product dropped, the 11 measures
    through the decimal-comma parser (F1). With several batches (a ``batch`` column
    ordered like the loads) the later batch wins for a name (D10)."""
    product = strip(F.col("PRODUCTO"))
    cols = [product.alias("ingredient_name"),
            F.coalesce(strip(F.col("CLASIFICACION")), F.lit("")).alias("classification")]
    cols += [decimal_comma(F.col(f"`{src}`"), QTY).alias(dst) for src, dst in NUTRITION_MEASURES]
    if "batch" in raw.columns:
        cols.append(F.col("batch"))
    out = raw.select(*cols).filter(F.col("ingredient_name").isNotNull() & (F.col("ingredient_name") != ""))
    if "batch" in raw.columns:
        out = latest_per_key(out, ["ingredient_name"], "batch").drop("batch")
    return out


def read_ingredient_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S3: read ingredient sheets (7 columns, no header); see ``parse_ingredients``."""
    return parse_ingredients(_sheets(spark, path, INGREDIENT_SHEET, header=False))


def parse_ingredients(raw: DataFrame) -> DataFrame:
    """S3 rules: names stripped (accents kept), price and quantity with thousands dots
    (F2), unit from the presentation (F3), classification normalised (F4), merged by
    name (the later batch wins)."""
    out = raw.select(
        strip(F.col("name")).alias("name"),
        normalise_class(F.col("classification")).alias("classification"),
        strip(F.col("brand")).alias("brand"), strip(F.col("supplier")).alias("supplier"),
        strip(F.col("presentation")).alias("presentation"),
        unit_from_presentation(F.col("presentation")).alias("measure"),
        thousands_dot(F.col("cost")).alias("cost"),
        thousands_dot(F.col("qty")).alias("count"),
        *(["batch"] if "batch" in raw.columns else []))
    out = out.filter(F.col("name").isNotNull() & (F.col("name") != ""))
    if "batch" in raw.columns:
        out = latest_per_key(out, ["name"], "batch").drop("batch")
    return out


def browse(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """All columns of an allow-listed table; any other name is refused."""
    if name not in BROWSABLE:
        raise PermissionError(f"table not allowed: {name}")
    if name not in tables:
        raise KeyError(name)
    return tables[name]
