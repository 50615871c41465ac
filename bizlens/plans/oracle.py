"""SQL text of the canonical views, for the DuckDB oracle.

These mirror ``bizlens.sources.views`` one to one; every oracle query inlines
the views it needs as CTEs because only the base tables are registered.
"""

from __future__ import annotations

VIEW_SQL = {
    "sales": """sales AS (
  SELECT CAST(o_orderdate AS DATE) AS order_date, o_orderkey AS order_id, c_name AS customer,
         concat(p_name, ' #', CAST(p_partkey AS VARCHAR)) AS product, p_type AS category, p_brand AS brand,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue, l_quantity AS quantity, p_retailprice AS price,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS commission,
         l_returnflag = 'R' AS returns
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey)""",
    "sales_a": """sales_a AS (
  SELECT * FROM sales WHERE order_date < DATE '1998-04-01' AND category <> 'PROMO')""",
    "sales_b": """sales_b AS (
  SELECT * FROM sales WHERE order_date >= DATE '1998-04-01' AND category <> 'ECONOMY')""",
    "sales_promo": """sales_promo AS (
  SELECT * REPLACE (CASE WHEN category = 'PROMO' THEN 'PROMO' ELSE product END AS product,
                    CASE WHEN category = 'PROMO' THEN revenue * 100 ELSE revenue END AS revenue) FROM sales)""",
    "inventory": """inventory AS (
  SELECT concat(p_name, ' #', CAST(p_partkey AS VARCHAR)) AS product, CAST(p_size AS DOUBLE) AS stock,
         coalesce(q.qty, 0) AS quantity
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey) q
    ON p_partkey = q.l_partkey)""",
    "dirty": """dirty AS (
  SELECT CAST(ts AS DATE) AS day, user_id,
         CASE WHEN event_type <> 'error' THEN event_type END AS category,
         CASE WHEN value >= 5 THEN CAST(value AS DECIMAL(18,2)) END AS revenue
  FROM events)""",
    "numeric_mix": """numeric_mix AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS amount,
         l_extendedprice * 1.1 + l_quantity AS gross, l_discount AS discount, 1 AS constant_col,
         CASE WHEN l_discount > 0.01 THEN l_tax END AS tax, l_returnflag AS segment
  FROM lineitem)""",
    "orders_text_dates": """orders_text_dates AS (
  SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS order_date, o_totalprice AS amount FROM orders)""",
}

# views that other views are built from
VIEW_DEPS = {"sales_a": ["sales"], "sales_b": ["sales"], "sales_promo": ["sales"]}


def with_views(*views: str) -> str:
    """``WITH`` clause defining the given views (and what they depend on)."""
    ordered: list[str] = []

    def add(v: str) -> None:
        for dep in VIEW_DEPS.get(v, []):
            add(dep)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        add(v)
    return "WITH " + ",\n".join(VIEW_SQL[v] for v in ordered) + "\n"
