"""Daily store and product aggregates, their totals and the reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillclose.functions.money import half_up, ratio
from tillclose.operators.row_contract import active_lines


def _money(value: Column) -> Column:
    return value.cast("decimal(28,2)")


def gold_store_day(state: DataFrame) -> DataFrame:
    """Per day and store. Rows are combined per sale before the store/day shuffle, so a hot
    store arrives as partial sums."""
    sales = F.countDistinct(F.struct("source_system", "sale_id"))
    revenue = F.sum("line_net_brl")
    return (
        active_lines(state)
        .groupBy("business_date", "store_id")
        .agg(
            _money(revenue).alias("net_revenue_brl"),
            F.sum("quantity").alias("units"),
            F.count(F.lit(1)).alias("item_lines"),
            sales.alias("sales_count"),
            _money(revenue / sales).alias("average_ticket_brl"),
        )
    )


def gold_product_day(state: DataFrame) -> DataFrame:
    return (
        active_lines(state)
        .groupBy("business_date", "product_id")
        .agg(
            _money(F.sum("line_net_brl")).alias("net_revenue_brl"),
            F.sum("quantity").alias("units"),
            F.count(F.lit(1)).alias("item_lines"),
        )
    )


def advance_gold(previous: DataFrame | None, state: DataFrame, dates: DataFrame, build) -> DataFrame:
    """A gold table after a batch: the touched days are built again, the others are kept.

    ``build`` is ``gold_store_day`` or ``gold_product_day``. Only rows of touched days are
    shuffled.
    """
    rebuilt = build(state.join(dates, "business_date", "left_semi"))
    if previous is None:
        return rebuilt
    return previous.join(dates, "business_date", "left_anti").unionByName(rebuilt)


SALE_DAY = ["business_date", "store_id", "source_system", "sale_id"]


def sale_lines(state: DataFrame) -> DataFrame:
    """Active lines of every sale on each day: what tells whether a sale still counts."""
    return active_lines(state).groupBy(*SALE_DAY).agg(F.count(F.lit(1)).alias("lines"))


def sale_deltas(lines: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Sales whose lines a batch changes: ``lines`` before and ``change``. Only their keys are joined."""
    moved = changes.groupBy(*SALE_DAY).agg(F.sum("sign").alias("change")).filter("change <> 0")
    if lines is None:
        return moved.withColumn("lines", F.lit(0).cast("bigint"))
    return moved.join(lines, SALE_DAY, "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


def advance_sale_lines(lines: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The table of sale lines after a batch; sales without lines leave it."""
    now = deltas.select(*SALE_DAY, (F.col("lines") + F.col("change")).alias("lines")).filter("lines > 0")
    if lines is None:
        return now
    return lines.join(deltas.select(*SALE_DAY), SALE_DAY, "left_anti").unionByName(now)


def _signed(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of a batch's changes: what it brings less what it takes away."""
    return changes.groupBy(*keys).agg(
        F.sum(F.col("line_net_brl") * F.col("sign")).alias("revenue"),
        F.sum(F.col("quantity") * F.col("sign")).alias("quantity"),
        F.sum("sign").alias("rows"),
    )


def _moved(previous: DataFrame | None, deltas: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """A table of sums after its deltas. Rows are added up by key, so a key that no delta names passes as it is;
    a row without lines leaves."""
    rows = deltas.select(*keys, *(F.col(new).cast("decimal(38,2)" if old == "net_revenue_brl" else "bigint").alias(old) for old, new in sums.items()))
    if previous is not None:
        # The touched keys alone meet the deltas; the others are not shuffled with them.
        named = deltas.select(*keys)
        touched = previous.join(named, keys, "left_semi").select(*rows.columns)
        rows = rows.unionByName(touched)
    return rows.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in sums)).filter("item_lines > 0")


def advance_store_day(previous: DataFrame | None, changes: DataFrame, sales: DataFrame) -> DataFrame:
    """``gold_store_day`` after a batch, from the previous table and signed changes.

    ``sales`` are ``sale_deltas``: a sale whose lines go from none to some counts once more, from some to none
    once less. Nothing of the state is read beyond the delivered items.
    """
    keys = ["business_date", "store_id"]
    turn = F.when(F.col("lines") == 0, 1).when(F.col("lines") + F.col("change") == 0, -1).otherwise(0)
    counted = sales.groupBy(*keys).agg(F.sum(turn).alias("sales"))
    deltas = _signed(changes, keys).join(counted, keys, "left").withColumn("sales", F.coalesce("sales", F.lit(0)))
    sums = {"net_revenue_brl": "revenue", "units": "quantity", "item_lines": "rows", "sales_count": "sales"}
    moved = _moved(previous, deltas, keys, sums)
    # As wide as the sum of the full build, so that the quotient is rounded alike.
    revenue = F.col("net_revenue_brl").cast("decimal(34,2)")
    moved = moved.withColumn("average_ticket_brl", _money(revenue / F.col("sales_count"))).withColumn(
        "net_revenue_brl", _money(F.col("net_revenue_brl"))
    )
    return moved if previous is None else previous.join(deltas.select(*keys), keys, "left_anti").unionByName(moved)


def advance_product_day(previous: DataFrame | None, changes: DataFrame) -> DataFrame:
    """``gold_product_day`` after a batch, from the previous table and signed changes."""
    keys = ["business_date", "product_id"]
    deltas = _signed(changes, keys)
    sums = {"net_revenue_brl": "revenue", "units": "quantity", "item_lines": "rows"}
    moved = _moved(previous, deltas, keys, sums).withColumn("net_revenue_brl", _money(F.col("net_revenue_brl")))
    return moved if previous is None else previous.join(deltas.select(*keys), keys, "left_anti").unionByName(moved)


def table_totals(frame: DataFrame, revenue: str, units: str, lines: str | None) -> DataFrame:
    """Grand totals; ``lines`` names the column to sum, None counts the rows."""
    counted = F.count(F.lit(1)) if lines is None else F.sum(lines)
    return frame.agg(
        F.coalesce(_money(F.sum(revenue)), F.lit(0).cast("decimal(28,2)")).alias(
            "net_revenue_brl"
        ),
        F.coalesce(F.sum(units), F.lit(0)).alias("units"),
        F.coalesce(counted, F.lit(0)).alias("item_lines"),
    )


def reconcile(state: DataFrame, store_day: DataFrame, product_day: DataFrame) -> DataFrame:
    """Totals of the state next to those of both aggregates; ``agrees`` must hold in each row."""
    base = table_totals(active_lines(state), "line_net_brl", "quantity", None)
    sides = [("silver", base)] + [
        (name, table_totals(frame, "net_revenue_brl", "units", "item_lines"))
        for name, frame in (("gold_store_day", store_day), ("gold_product_day", product_day))
    ]
    rows = None
    for name, totals in sides:
        side = totals.select(F.lit(name).alias("side"), "*")
        rows = side if rows is None else rows.unionByName(side)
    figures = F.struct("net_revenue_brl", "units", "item_lines")
    return (
        rows.groupBy()
        .agg(F.collect_list(F.struct("side", figures.alias("f"))).alias("sides"))
        .select(
            F.explode("sides").alias("s"),
            (F.size(F.array_distinct(F.transform("sides", lambda s: s["f"]))) == 1).alias(
                "agrees"
            ),
        )
        .select("s.side", "s.f.*", "agrees")
    )


def publication_summary(store_day: DataFrame) -> DataFrame:
    """Headline totals. A confirmed empty publication is zero, an absent metric stays null."""
    empty = F.count(F.lit(1)) == 0

    def total(column: str, kind: str) -> Column:
        return F.when(empty, F.lit(0).cast(kind)).otherwise(F.sum(column).cast(kind))

    return store_day.agg(
        total("net_revenue_brl", "decimal(28,2)").alias("net_revenue_brl"),
        total("units", "bigint").alias("units"),
        total("item_lines", "bigint").alias("item_lines"),
        total("sales_count", "bigint").alias("sales_count"),
        F.min("business_date").alias("first_date"),
        F.max("business_date").alias("last_date"),
        F.count(F.lit(1)).alias("store_days"),
    ).withColumn(
        "average_ticket_brl",
        half_up(
            ratio(
                F.coalesce("net_revenue_brl", F.lit(0)).cast("decimal(28,2)"),
                F.col("sales_count").cast("decimal(20,0)"),
            ),
            2,
        ).cast("decimal(28,2)"),
    )


def daily_revenue(store_day: DataFrame) -> DataFrame:
    return (
        store_day.groupBy("business_date")
        .agg(_money(F.sum("net_revenue_brl")).alias("net_revenue_brl"))
        .orderBy("business_date")
    )


def scope_counts(store_day: DataFrame) -> DataFrame:
    return store_day.agg(
        F.countDistinct("store_id").alias("stores"),
        F.countDistinct("business_date").alias("days"),
        _money(F.sum("net_revenue_brl")).alias("net_revenue_brl"),
        F.sum("units").alias("units"),
        F.sum("sales_count").alias("sales_count"),
    )
