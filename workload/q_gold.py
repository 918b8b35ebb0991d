"""Daily aggregates and the totals derived from them."""

from __future__ import annotations

from tillclose.operators import gold as G
from workload.base import query
from workload.feed import half_up, money, product_day, state, store_day

NET = f"{money('net_cents')} AS net_revenue_brl"
TOTALS = (
    f"{money('coalesce(sum(net_cents), 0)')} AS net_revenue_brl, "
    "CAST(coalesce(sum(units), 0) AS BIGINT) AS units, "
    "CAST(coalesce(sum(item_lines), 0) AS BIGINT) AS item_lines"
)


@query(
    "gold_store_day",
    ["store_cents"],
    f"SELECT business_date, store_id, {NET}, units, item_lines, sales_count, "
    f"{money(half_up('net_cents', 'sales_count'))} AS average_ticket_brl FROM store_cents",
)
def gold_store_day(spark, folder):
    return store_day(spark, folder)


@query(
    "gold_product_day",
    ["product_cents"],
    f"SELECT business_date, product_id, {NET}, units, item_lines FROM product_cents",
)
def gold_product_day(spark, folder):
    return product_day(spark, folder)


@query("table_totals", ["store_cents"], f"SELECT {TOTALS} FROM store_cents")
def table_totals(spark, folder):
    return G.table_totals(store_day(spark, folder), "net_revenue_brl", "units", "item_lines")


@query(
    "reconcile",
    ["active", "store_cents", "product_cents"],
    f"""
    , sides AS (
        SELECT 'silver' AS side, {money('sum(net_cents)')} AS net_revenue_brl,
               CAST(sum(quantity) AS BIGINT) AS units, count(*) AS item_lines FROM active
        UNION ALL SELECT 'gold_store_day', {TOTALS} FROM store_cents
        UNION ALL SELECT 'gold_product_day', {TOTALS} FROM product_cents)
    SELECT *, (SELECT count(DISTINCT (net_revenue_brl, units, item_lines)) FROM sides) = 1 AS agrees
    FROM sides
    """,
)
def reconcile(spark, folder):
    return G.reconcile(state(spark, folder), store_day(spark, folder), product_day(spark, folder))


@query(
    "publication_summary",
    ["store_cents"],
    f"""
    SELECT {TOTALS}, CAST(sum(sales_count) AS BIGINT) AS sales_count,
           min(business_date) AS first_date, max(business_date) AS last_date,
           count(*) AS store_days,
           {money(half_up('CAST(sum(net_cents) AS HUGEINT)', 'CAST(sum(sales_count) AS HUGEINT)'))}
               AS average_ticket_brl
    FROM store_cents
    """,
)
def publication_summary(spark, folder):
    return G.publication_summary(store_day(spark, folder))


@query(
    "daily_revenue",
    ["store_cents"],
    f"SELECT business_date, {money('sum(net_cents)')} AS net_revenue_brl FROM store_cents GROUP BY 1",
)
def daily_revenue(spark, folder):
    return G.daily_revenue(store_day(spark, folder))


@query(
    "scope_counts",
    ["store_cents"],
    f"""
    SELECT count(DISTINCT store_id) AS stores, count(DISTINCT business_date) AS days,
           {money('sum(net_cents)')} AS net_revenue_brl, CAST(sum(units) AS BIGINT) AS units,
           CAST(sum(sales_count) AS BIGINT) AS sales_count FROM store_cents
    """,
)
def scope_counts(spark, folder):
    return G.scope_counts(store_day(spark, folder))
