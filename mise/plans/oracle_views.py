"""The adapter views as plain SQL CTEs, for the independent DuckDB oracle.

Written from the fixture rules, not from the Spark code, so that the oracle check
also covers the adapters. ``with_views(body, *names)`` prepends the CTEs a query needs
(with their dependencies) to a SELECT.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def _v(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_v("ingredient_table", [], """
SELECT p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) AS name,
       CAST(CASE WHEN p.p_partkey % 17 = 0 THEN 0
                 WHEN p.p_partkey % 13 = 0 THEN p.p_partkey % 5
                 WHEN p.p_partkey % 97 = 3 THEN -5
                 ELSE (p.p_partkey * 37) % 5000 END AS DECIMAL(12,2)) AS count,
       CAST(CASE WHEN p.p_partkey % 29 = 0 THEN 0 ELSE p.p_retailprice END AS DECIMAL(12,2)) AS cost,
       CASE p.p_partkey % 7 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'l'
            WHEN 4 THEN 'lb' WHEN 5 THEN 'u' ELSE ' Unidad ' END AS measure,
       CASE WHEN p.p_partkey % 23 = 0 THEN NULL ELSE p.p_type END AS classification,
       p.p_brand AS brand,
       CASE WHEN p.p_partkey % 31 = 0 THEN NULL
            WHEN p.p_partkey % 31 = 1 THEN ''
            WHEN p.p_partkey % 31 = 2 THEN ' ' || upper(s.s_name) || ' '
            ELSE s.s_name END AS supplier,
       CASE p.p_size % 8 WHEN 0 THEN 'KILO' WHEN 1 THEN 'FRASCO X 500 ML'
            WHEN 2 THEN 'BOLSA X 200 GRAMOS' WHEN 3 THEN 'LIBRA' WHEN 4 THEN 'UNIDAD'
            WHEN 5 THEN 'GARRAFA X 5000' WHEN 6 THEN 'LITRO' ELSE 'CHAPETA X 25 G' END AS presentation,
       CAST(CASE WHEN p.p_partkey % 19 = 0 THEN NULL
                 WHEN p.p_partkey % 97 = 3 THEN 0
                 WHEN p.p_partkey % 13 = 0 THEN p.p_partkey % 5
                 ELSE (p.p_partkey * 11) % 900 END AS DECIMAL(12,2)) AS min_stock
FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey % (SELECT count(*) FROM supplier)""")

_v("menu_board", [], """
SELECT p_partkey AS id, p_type AS category,
       upper(p_name) || ' ' || CAST(p_partkey AS VARCHAR) AS dish_name,
       CAST(p_size AS INTEGER) AS sort_order,
       CASE WHEN p_partkey % 7 = 0 THEN 'inactivo' ELSE 'activo' END AS status,
       CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1000 + p_partkey % 3000 END AS DECIMAL(10,2)) AS cost_total,
       CAST((p_partkey % 10) * 10 AS DECIMAL(10,2)) AS overhead_cost,
       CAST(CASE WHEN p_partkey % 35 = 0 THEN 0 ELSE 1500 + (p_partkey * 13) % 4000 END AS DECIMAL(10,2)) AS sale_price,
       CAST(CASE WHEN p_partkey % 45 = 0 THEN 0 ELSE p_size * 10 END AS INTEGER) AS portion_weight_g
FROM part""")

_v("menu_recipe_items", ["menu_board"], """
SELECT m.id * 10 + k.k AS id, m.id AS dish_id,
       CASE WHEN (m.id + k.k) % 11 = 0 THEN CAST(0 AS BIGINT) END AS menu_item_id,
       CASE WHEN (m.id + k.k) % 41 = 0 THEN 'UNKNOWN INGREDIENT'
            ELSE (SELECT p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) FROM part p
                  WHERE p.p_partkey = (m.id * 7 + k.k * 13) % (SELECT count(*) FROM part)) END
            AS ingredient_name,
       CAST(1 + (m.id + k.k * 31) % 400 AS DECIMAL(10,2)) AS quantity_grams,
       CAST(CASE (m.id + k.k) % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0.0049
                 ELSE CAST((m.id + k.k) % 50 AS DECIMAL(10,4)) / 10 END AS DECIMAL(10,4)) AS unit_cost
FROM menu_board m, (VALUES (1), (2), (3), (4)) k(k)
WHERE k.k <= 1 + m.id % 4 AND m.id % 50 <> 45""")

_v("sale_items", [], """
SELECT l_orderkey AS sale_id, l_partkey AS dish_id,
       CAST(l_quantity AS INTEGER) AS quantity,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS line_sale,
       CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) * 0.6, 2)
            AS DECIMAL(12,2)) AS line_cost,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2))
            - CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) * 0.6, 2)
                   AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS line_profit
FROM lineitem""")

_v("daily_sales", ["sale_items"], """
SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS TIMESTAMP) AS created_at,
       CAST(coalesce(t.s, 0) AS DECIMAL(12,2)) AS total_sale,
       CAST(coalesce(t.c, 0) AS DECIMAL(12,2)) AS total_cost,
       CAST(coalesce(t.p, 0) AS DECIMAL(12,2)) AS total_profit,
       CAST(coalesce(t.q, 0) AS INTEGER) AS items_count
FROM orders o LEFT JOIN (
  SELECT sale_id, sum(line_sale) s, sum(line_cost) c, sum(line_profit) p, sum(quantity) q
  FROM sale_items GROUP BY sale_id) t ON t.sale_id = o.o_orderkey""")

_v("projection_rows", ["menu_board"], """
SELECT id, id AS dish_id, dish_name, CAST(1 + id % 60 AS INTEGER) AS projected_units,
       (id % 6 <> 0) AS is_active
FROM menu_board""")

_v("precios_competencia", [], """
SELECT p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) AS ingrediente,
       st.store AS supermercado,
       p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) AS producto,
       CAST(NULL AS VARCHAR) AS presentacion,
       CAST(round(CAST(p.p_retailprice AS DECIMAL(12,2))
                  * CAST(70 + (p.p_partkey * 7 + st.s * 3 + dt.d * 5) % 80 AS DECIMAL(5,0)) * 0.01, 2)
            AS DECIMAL(12,2)) AS precio,
       CAST(NULL AS VARCHAR) AS url,
       dt.day AS fecha_scrape
FROM part p,
     (VALUES (0, 'Olímpica'), (1, 'Carulla'), (2, 'Éxito'), (3, 'Makro')) st(s, store),
     (VALUES (0, DATE '2024-01-01'), (1, DATE '2024-01-08'), (2, DATE '2024-01-15')) dt(d, day)
WHERE (p.p_partkey + st.s) % 3 <> 0""")

_v("nutrition_table", [], """
SELECT p_name || ' #' || CAST(p_partkey AS VARCHAR) AS ingredient_name,
       p_type AS classification,
       CAST(p_partkey % 40 AS DECIMAL(10,2)) AS protein_g,
       CAST(p_partkey % 25 AS DECIMAL(10,2)) AS fat_g,
       CAST(p_partkey % 70 AS DECIMAL(10,2)) AS carbs_g,
       CAST(p_partkey % 12 AS DECIMAL(10,2)) AS fiber_g,
       CAST((p_partkey * 3) % 900 AS DECIMAL(10,2)) AS sodium_mg,
       CAST((p_partkey % 40) * 4 + (p_partkey % 25) * 9 + (p_partkey % 70) * 4 AS DECIMAL(10,2)) AS total_calories
FROM part WHERE p_partkey % 8 <> 0""")

_v("ticket_lines", [], """
SELECT event_id AS ticket_id, event_id AS line_id, CAST(ts AS TIMESTAMP) AS ts,
       event_id % (SELECT count(*) FROM part) AS dish_id, CAST(1 + user_id % 4 AS INTEGER) AS quantity
FROM events WHERE event_type = 'purchase'""")

_v("ticket_lines_multi", [], """
SELECT event_id - event_id % 3 AS ticket_id, event_id AS line_id, CAST(ts AS TIMESTAMP) AS ts,
       event_id % (SELECT count(*) FROM part) AS dish_id, CAST(1 + user_id % 4 AS INTEGER) AS quantity
FROM events WHERE event_type = 'purchase'""")

_v("stock_events", [], """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'delivery' ELSE 'count' END AS kind,
       event_id % (SELECT count(*) FROM part) AS dish_id, CAST(1 + user_id % 4 AS INTEGER) AS quantity,
       CAST((event_id * 37) % 5000 AS DECIMAL(12,2)) AS counted
FROM events WHERE event_type IN ('purchase', 'signup', 'error')""")

_v("stock_moves", ["stock_events", "menu_recipe_items"], """
SELECT r.ingredient_name AS name, e.ts, e.seq, e.kind,
       CASE e.kind WHEN 'count' THEN 0 WHEN 'delivery' THEN 1 ELSE 2 END AS rank,
       CASE WHEN e.kind = 'count' THEN max(e.counted) ELSE sum(r.quantity_grams * e.quantity) END AS amount
FROM stock_events e JOIN menu_recipe_items r ON r.dish_id = e.dish_id GROUP BY r.ingredient_name, e.ts, e.seq, e.kind""")

_v("user_profiles", [], """
SELECT c_custkey AS id,
       lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com' AS email,
       c_mktsegment AS role, CAST(c_acctbal AS DECIMAL(12,2)) AS balance
FROM customer""")


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str) -> str:
    if not names:
        return body
    order = _order(list(names))
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
