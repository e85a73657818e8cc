"""Scalar rules as Spark Column builders (F1-F12 and the P-predicates).

All of them are Catalyst expressions: they stay inside whole-stage codegen and
never call Python per row. Parsing uses ``try_cast`` so that ANSI mode turns bad
text into NULL (and then into the rule's default) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact decimal types used throughout.
MONEY = "decimal(12,2)"
QTY = "decimal(10,2)"
UNIT_COST = "decimal(10,4)"
PER_GRAM = "decimal(20,10)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- F1 / F2 / F6
def decimal_comma(x, to: str = QTY) -> Column:
    """strip, drop spaces, ',' -> '.', blank/NULL/invalid -> 0."""
    s = F.regexp_replace(_c(x).cast("string"), r"\s", "")
    s = F.regexp_replace(s, ",", ".")
    return F.coalesce(_try_cast(s, to), F.lit(0).cast(to))


def thousands_dot(x, to: str = MONEY) -> Column:
    """F2: Colombian price text: remove '.', ',' -> '.', blank -> 0 ("2.400" -> 2400)."""
    s = F.regexp_replace(F.trim(_c(x).cast("string")), r"\.", "")
    s = F.regexp_replace(F.regexp_replace(s, ",", "."), r"\s", "")
    return F.coalesce(_try_cast(s, to), F.lit(0).cast(to))


def lenient_number(x, to: str = "double") -> Column:
    """any failure -> 0."""
    return F.coalesce(_try_cast(_c(x).cast("string"), to), F.lit(0).cast(to))


def strip(x) -> Column:
    """Python-style strip: leading and trailing whitespace of any kind (tabs too)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def _try_cast(col: Column, to: str) -> Column:
    return col.try_cast(to)


# ---------------------------------------------------------------- F3 / F4
def unit_from_presentation(x) -> Column:
    """unit inferred from the presentation text; first matching rule wins."""
    p = F.upper(F.coalesce(_c(x), F.lit("")))
    return (
        F.when(p.rlike(r"\bKILOS?\b"), "kg")
        .when(p.rlike(r"\d\s*(GRAMOS|GR|G)\b"), "g")
        .when(p.rlike(r"\d\s*ML\b"), "ml")
        .when(p.rlike(r"\b(LIBRAS?|LB)\b"), "lb")
        .when(p.rlike(r"\bUNIDAD(ES)?\b"), "u")
        .when(p.rlike(r"\b(LITROS?|LTS)\b"), "l")
        .otherwise("u")
    )


# Source classification -> normalised classification (must match the
# reference's load rules). "PROTEINA - <tipo>" is handled by a rule below.
CLASS_MAP = [
    ("ADEREZOS/CONDIMENTOS/ESPECIAS", "Aderezos/Condimentos/Especias"),
    ("AZUCARES - ENDULZANTES", "Azúcares - Endulzantes"),
    ("CEREALES - TUBERCULOS - CARBOHIDRATOS", "Cereales - Tubérculos - Carbohidratos"),
    ("FRUTAS", "Frutas"),
    ("FRUTAS - GRASAS", "Frutas - Grasas"),
    ("FRUTOS DESHIDRATADOS - AZUCARES", "Frutos Deshidratados - Azúcares"),
    ("GRASAS", "Grasas"),
    ("LACTEOS", "Lácteos"),
    ("LACTEOS - GRASAS", "Lácteos - Grasas"),
    ("LEGUMBRES - CARBOHIDRATOS", "Legumbres - Carbohidratos"),
    ("SEMILLAS/FRUTOS SECOS - GRASAS", "Semillas/Frutos Secos - Grasas"),
    ("VEGETALES", "Vegetales"),
    ("VEGETALES - CARBOHIDRATOS", "Vegetales - Carbohidratos"),
    ("VEGETALES - GRASAS", "Vegetales - Grasas"),
]


def normalise_class(x) -> Column:
    """map the 15 source classifications; unknown text is kept trimmed."""
    t = F.upper(F.trim(_c(x)))
    out = None
    for src, dst in CLASS_MAP:
        out = (F.when(t == src, dst) if out is None else out.when(t == src, dst))
    prot = F.regexp_extract(t, r"^PROTEINA\s*-\s*(.+)$", 1)
    out = out.when(prot != "", F.concat(F.lit("Proteína - "), F.initcap(F.lower(prot))))
    return out.otherwise(F.trim(_c(x)))


# ---------------------------------------------------------------- F5 / F7 / F8 / F9
def store_price_text(x, to: str = MONEY) -> Column:
    """remove '$' and '.', ',' -> '.', then the first ``[\\d.]+`` run."""
    s = F.regexp_replace(F.regexp_replace(_c(x), r"[$.]", ""), ",", ".")
    return _try_cast(F.nullif(F.regexp_extract(s, r"[\d.]+", 0), F.lit("")), to)


def unit_factor(measure) -> Column:
    """cost per measure unit -> cost per gram. lower+trim, NULL -> ''."""
    m = F.lower(F.trim(F.coalesce(_c(measure), F.lit(""))))
    return (
        F.when(m.isin("g", "ml", "u", "unidad"), F.lit(1).cast("decimal(10,8)"))
        .when(m.isin("kg", "l"), F.lit("0.001").cast("decimal(10,8)"))
        .when(m == "lb", F.lit("0.00220462").cast("decimal(10,8)"))
        .otherwise(F.lit(1).cast("decimal(10,8)"))
    )


def display_qty(grams, measure) -> Column:
    """F8: g, ml round 0; kg, l /1000 round 2; lb /453.592 round 2; other round 0.

    Division by 1000 is the exact product by 0.001 (no binary rounding at .xx5);
    the pound branch is a double division as in the reference. Returns decimal(20,2).
    """
    g = _c(grams)
    m = _c(measure)
    return (
        F.when(m.isin("kg", "l"), F.round(g * F.lit("0.001").cast("decimal(4,3)"), 2))
        .when(m == "lb", F.round(g.cast("double") / F.lit(453.592), 2))
        .otherwise(F.round(g, 0))
    ).cast("decimal(20,2)")


def stock_display(val, measure) -> Column:
    """lb /453.592 round 2; everything else /1000 round 3 (also 'u', see D6)."""
    v = _c(val)
    return F.when(_c(measure) == "lb", F.round(v.cast("double") / F.lit(453.592), 2)).otherwise(
        F.round(v * F.lit("0.001").cast("decimal(4,3)"), 3).cast("double"))


def stock_unit_label(measure) -> Column:
    m = _c(measure)
    return F.when(m == "g", "kg").when(m == "ml", "l").otherwise(m)


# ---------------------------------------------------------------- F10 / F11 / F12
def strip_tags(x) -> Column:
    return F.regexp_replace(_c(x), r"<[^>]*>", "")


def excerpt(x, n: int = 120) -> Column:
    """tag-stripped text cut to ``n`` characters."""
    return F.substring(strip_tags(x), 1, n)


def pg_array(x) -> Column:
    """PostgreSQL array text ``{a,"b c"}`` -> array of non-empty strings."""
    parts = F.split(F.regexp_replace(_c(x), r'[{}"]', ""), ",")
    return F.filter(parts, lambda e: e != "")


def day_of(x) -> Column:
    """ISO timestamp text -> date; else the first 10 characters as a date."""
    s = _c(x).cast("string")
    return F.coalesce(F.to_date(F.try_to_timestamp(s)), F.substring(s, 1, 10).try_cast("date"))


def norm_key(x) -> Column:
    """upper(trim()) join key."""
    return F.upper(F.trim(_c(x)))


# ---------------------------------------------------------------- predicates
def stock_state_report(count, min_stock) -> Column:
    """SIN STOCK / BAJO / OK (SQL report rule)."""
    c, m = _c(count), _c(min_stock)
    return F.when(c <= 0, "SIN STOCK").when(c < m, "BAJO").otherwise("OK")


def stock_state_fixed(count, threshold: int = 5) -> Column:
    """P10: out / low / ok against a fixed threshold."""
    c = _c(count)
    return F.when(c <= 0, "out").when(c < threshold, "low").otherwise("ok")


def margin_pct(price, cost) -> Column:
    """(price-cost)/price*100 rounded 1; NULL when price is 0 (dashboard rule)."""
    p = _c(price).cast("decimal(12,2)")
    c = _c(cost).cast("decimal(12,2)")
    # division in double, as the SQL engines do for decimals
    return F.round((p - c).cast("double") / F.nullif(p, F.lit(0)).cast("double") * 100, 1)


def margin_band(pct) -> Column:
    """>=50 high, >=20 medium, else low."""
    m = _c(pct)
    return F.when(m >= 50, "high").when(m >= 20, "medium").otherwise("low")


def price_cell(price, our_cost) -> Column:
    """P20: cheaper / dearer when both present and our cost > 0, else ''."""
    p, c = _c(price), _c(our_cost)
    ok = p.isNotNull() & c.isNotNull() & (c > 0)
    return F.when(ok & (p < c), "cheaper").when(ok, "dearer").otherwise("")


def profit_sign(x) -> Column:
    """P21: 'positive' when profit >= 0 else 'negative'."""
    return F.when(_c(x) >= 0, "positive").otherwise("negative")


def month_start(as_of: str) -> Column:
    return F.trunc(F.lit(as_of).cast("date"), "month")


def next_month_start(d) -> Column:
    """First day of the next month."""
    return F.date_add(F.last_day(_c(d)), 1)


def thirty_days_on(d) -> Column:
    """P23, table default: 30 days after the start."""
    return F.date_add(_c(d), 30)
