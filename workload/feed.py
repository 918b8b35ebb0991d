"""The given tables read as a feed of item revisions, in Spark and in SQL.

``lineitem`` repeats (order, line); the repeats are the revisions of an item. Every column is
computed from its own row, so the feed needs no window: the revision is the day the row ships
(``dated``) or one of two numbers the supplier implies (``claimed``, which makes many revision
conflicts). Batch B1 is the published history, B2 the incoming delivery. Money is derived in
whole cents so that both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillclose.functions.contract import business_day
from tillclose.functions.money import cents_to_money
from tillclose.operators import gold, revisions
from tillclose.schemas import REVISION_KEY
from tillclose.session import scratch_path, shuffles_removed
from workload.base import part


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """What several steps read, written once: it is not computed again, and Spark knows its size."""
    path = scratch_path(frame.sparkSession, label)
    # Not compressed further than usual: Spark takes the size of the files for that of the rows where it joins them.
    with shuffles_removed(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def feed_cents(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    # Dealt by the text of the sale: the join, and every grouping by a key that holds the sale, finds its rows in
    # place, so the wide rows made from them are not shuffled again.
    lines = lines.withColumn("sale_id", F.col("l_orderkey").cast("string")).repartition("sale_id")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("sale_id"), "o_custkey")
    percent = F.round(F.col("l_discount") * 100).cast("bigint")
    return (
        lines.join(orders, "sale_id")
        .withColumn("store_no", (F.col("o_custkey") % 12 + 1).cast("int"))
        .withColumn("quantity", F.col("l_quantity").cast("int"))
        .withColumn("unit_cents", F.expr("cast(round(l_extendedprice * 100) as bigint) div quantity"))
        .withColumn("gross_cents", F.col("quantity") * F.col("unit_cents"))
        .withColumn("_percent", percent)
        .withColumn("discount_cents", F.expr("gross_cents * _percent div 100"))
        .withColumn("day_no", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")))
        .drop("_percent")
    )


def feed(spark: SparkSession, folder: str, revision: str = "dated") -> DataFrame:
    """Typed rows of both batches, shaped like the history table."""
    rows = feed_cents(spark, folder)
    number = F.col("day_no") if revision == "dated" else (F.col("l_suppkey") % 2 + 1)
    moment = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(
        hours=(F.col("l_orderkey") % 24).cast("int")
    )
    identity = [
        "source_system", "store_id", "sale_id", "line_id", "day_no", "operation",
        "product_id", "quantity", "unit_cents", "discount_cents",
    ]
    named = rows.select(
        F.lit("pos").alias("source_system"),
        F.concat(F.lit("S"), F.lpad(F.col("store_no").cast("string"), 2, "0")).alias("store_id"),
        "sale_id",
        F.col("l_linenumber").cast("string").alias("line_id"),
        number.cast("int").alias("revision"),
        F.when(F.col("l_returnflag") == "R", "CANCEL").otherwise("UPSERT").alias("operation"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
        moment.alias("sold_at"),
        "quantity",
        "unit_cents",
        "gross_cents",
        "discount_cents",
        "day_no",
        F.when(F.col("l_linestatus") == "F", "B1").otherwise("B2").alias("batch_id"),
        (F.col("l_partkey") * 53 + F.col("l_suppkey") * 7 + F.col("quantity"))
        .cast("int")
        .alias("source_line"),
    )
    return named.select(
        "source_system",
        "store_id",
        "sale_id",
        "line_id",
        "revision",
        "operation",
        "product_id",
        "sold_at",
        "quantity",
        cents_to_money(F.col("unit_cents")).alias("unit_price_brl"),
        cents_to_money(F.col("discount_cents")).alias("line_discount_brl"),
        F.col("sold_at").alias("source_updated_at"),
        "batch_id",
        F.concat(F.lit("run-"), F.col("batch_id")).alias("run_id"),
        F.concat("store_id", F.lit(".csv")).alias("source_file"),
        "source_line",
        F.sha2(F.concat_ws("|", *identity), 256).alias("payload_hash"),
        business_day(F.col("sold_at")).alias("business_date"),
        cents_to_money(F.col("gross_cents") - F.col("discount_cents"), "decimal(24,2)").alias(
            "line_net_brl"
        ),
    )


def batches(
    spark: SparkSession, folder: str, revision: str = "dated"
) -> tuple[DataFrame, DataFrame]:
    """(published history, incoming delivery)."""
    rows = feed(spark, folder, revision)
    return rows.filter("batch_id = 'B1'"), rows.filter("batch_id = 'B2'")


#: What the daily aggregates need of a line, beside its key and revision.
GOLD_COLUMNS = ["operation", "product_id", "business_date", "quantity", "line_net_brl"]


def published(spark: SparkSession, folder: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """State after the first batch and the rows the second adds to the history, each written once with the key,
    the revision and ``columns`` only."""
    previous, incoming = (_needed(rows, columns) for rows in batches(spark, folder))
    history = revisions.eligible_history(None, previous)
    before, added = revisions.current_state(history), revisions.new_history_rows(history, incoming)
    before, added = (rows.select(*REVISION_KEY, *columns) for rows in (before, added))
    return stored(before, "before"), stored(added, "added")


def _needed(rows: DataFrame, columns: list[str] | None) -> DataFrame:
    """The key, what ranks the rows of an item, and ``columns``: what resolving carries along is never pruned."""
    return rows if columns is None else rows.select(*dict.fromkeys([*REVISION_KEY, *columns, *revisions.ARRIVAL]))


def state(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Current state after both batches."""
    return revisions.resolve_state(None, _needed(feed(spark, folder), columns))


def previous_state(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """State as published after the first batch."""
    return revisions.resolve_state(None, _needed(batches(spark, folder)[0], columns))


def store_day(spark: SparkSession, folder: str) -> DataFrame:
    return gold.gold_store_day(state(spark, folder, GOLD_COLUMNS))


def product_day(spark: SparkSession, folder: str) -> DataFrame:
    return gold.gold_product_day(state(spark, folder, GOLD_COLUMNS))


# ---- the same in SQL --------------------------------------------------------------------
part(
    "cents",
    [],
    """
    SELECT *, gross_cents * CAST(round(l_discount * 100) AS BIGINT) // 100 AS discount_cents
    FROM (SELECT *, quantity * unit_cents AS gross_cents
          FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount,
                       l_returnflag, l_linestatus, l_shipdate,
                       CAST(o_custkey % 12 + 1 AS INT) AS store_no,
                       CAST(l_quantity AS BIGINT) AS quantity,
                       CAST(round(l_extendedprice * 100) AS BIGINT)
                         // CAST(l_quantity AS BIGINT) AS unit_cents,
                       date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS day_no
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
    """,
)


def _feed_sql(revision: str) -> str:
    return f"""
    SELECT *, sha256(concat_ws('|', source_system, store_id, sale_id, line_id, day_no, operation,
                               product_id, quantity, unit_cents, discount_cents)) AS payload_hash,
           CAST(timezone('America/Sao_Paulo', timezone('UTC', sold_at)) AS DATE) AS business_date,
           gross_cents - discount_cents AS net_cents, 'run-' || batch_id AS run_id,
           store_id || '.csv' AS source_file
    FROM (SELECT 'pos' AS source_system,
                 'S' || lpad(CAST(store_no AS VARCHAR), 2, '0') AS store_id,
                 CAST(l_orderkey AS VARCHAR) AS sale_id, CAST(l_linenumber AS VARCHAR) AS line_id,
                 CAST({revision} AS INT) AS revision,
                 CASE WHEN l_returnflag = 'R' THEN 'CANCEL' ELSE 'UPSERT' END AS operation,
                 'P' || CAST(l_partkey AS VARCHAR) AS product_id,
                 l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS sold_at,
                 quantity, unit_cents, gross_cents, discount_cents, day_no,
                 CASE WHEN l_linestatus = 'F' THEN 'B1' ELSE 'B2' END AS batch_id,
                 CAST(l_partkey * 53 + l_suppkey * 7 + quantity AS INT) AS source_line
          FROM cents)
    """


part("feed", ["cents"], _feed_sql("day_no"))
part("claimed", ["cents"], _feed_sql("l_suppkey % 2 + 1"))
ITEM = "source_system, store_id, sale_id, line_id"
ARRIVAL = "batch_id, source_file, source_line"


def _state_sql(source: str, where: str = "TRUE") -> str:
    return f"""
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY {ITEM}
                                     ORDER BY revision DESC, {ARRIVAL}) AS rn
        FROM {source} WHERE {where}) WHERE rn = 1
    """


part("state", ["feed"], _state_sql("feed"))
part("previous", ["feed"], _state_sql("feed", "batch_id = 'B1'"))
part("active", ["state"], "SELECT * FROM state WHERE operation = 'UPSERT'")


def money(cents: str, kind: str = "DECIMAL(28,2)") -> str:
    """SQL turning whole cents into an exact amount."""
    return f"CAST(CAST({cents} AS DECIMAL(30,0)) * CAST('0.01' AS DECIMAL(3,2)) AS {kind})"


def half_up(numerator: str, denominator: str) -> str:
    """SQL of a positive whole-number quotient rounded half up."""
    return f"((2 * ({numerator}) + ({denominator})) // (2 * ({denominator})))"


part(
    "store_cents",
    ["active"],
    """
    SELECT business_date, store_id, CAST(sum(net_cents) AS BIGINT) AS net_cents,
           CAST(sum(quantity) AS BIGINT) AS units, count(*) AS item_lines,
           count(DISTINCT (source_system, sale_id)) AS sales_count
    FROM active GROUP BY ALL
    """,
)
part(
    "product_cents",
    ["active"],
    """
    SELECT business_date, product_id, CAST(sum(net_cents) AS BIGINT) AS net_cents,
           CAST(sum(quantity) AS BIGINT) AS units, count(*) AS item_lines
    FROM active GROUP BY ALL
    """,
)
