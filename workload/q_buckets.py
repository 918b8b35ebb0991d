"""A state kept by buckets, advanced over four deliveries with tables written between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillclose.operators import audit
from tillclose.operators import revisions as R
from tillclose.session import scratch_path
from tillclose.sinks import buckets as B
from tillclose.sources import buckets as S
from workload.base import part, query
from workload.feed import ITEM, feed

BUCKETS = 64
#: The second batch comes in three deliveries, the last of them small.
FIRST, LAST = "1999-01-01", "2001-10-31"
COLUMNS = [*ITEM.split(", "), "revision", "operation", "product_id", "business_date", "quantity", "payload_hash"]
SALE_TEXT = "concat_ws(chr(1), source_system, store_id, sale_id)"

part(
    "delivered",
    ["feed"],
    f"""
    SELECT *, CASE WHEN batch_id = 'B1' THEN 0 WHEN business_date < DATE '{FIRST}' THEN 1
                   WHEN business_date <= DATE '{LAST}' THEN 2 ELSE 3 END AS delivery,
           CAST(CAST('0x' || md5({SALE_TEXT})[1:8] AS BIGINT) % {BUCKETS} AS INT) AS bucket
    FROM feed
    """,
)


def _layouts(spark, folder):
    """The layout after each delivery."""
    root = scratch_path(spark, "buckets")
    number = (
        F.when(F.col("batch_id") == "B1", 0)
        .when(F.col("business_date") < F.lit(FIRST).cast("date"), 1)
        .when(F.col("business_date") <= F.lit(LAST).cast("date"), 2)
        .otherwise(3)
    )
    # Every version keeps its files, so the rows hold what the queries tell of them and no more.
    # Deliveries are told from the given tables alone, so each shuffles its own narrow rows and none is stored.
    whole = feed(spark, folder).withColumn("delivery", number)
    found, layout = [], None
    for delivery in range(4):
        rows = whole.filter(F.col("delivery") == delivery).select(*COLUMNS, *R.ARRIVAL)
        layout = B.advance_buckets(
            spark, root, "silver", f"run-{delivery}", layout, rows,
            lambda before, where, rows=rows: R.resolve_state(before, rows, where), BUCKETS, placed=True,
        )
        found.append(layout)
    return found


@query(
    "advance_state_buckets",
    ["state"],
    f"SELECT {ITEM}, revision, operation, product_id, business_date, quantity, payload_hash FROM state",
)
def advance_state_buckets(spark, folder):
    return S.read_buckets(spark, _layouts(spark, folder)[-1]).select(*COLUMNS)


@query(
    "state_bucket_versions",
    ["delivered"],
    f"""
    SELECT bucket, CAST(max(delivery) AS BIGINT) AS held, count(DISTINCT ({ITEM})) AS "rows"
    FROM delivered GROUP BY bucket
    """,
)
def state_bucket_versions(spark, folder):
    last = _layouts(spark, folder)[-1]
    return S.read_map(spark, last.path, last.version).filter("rows > 0").select("bucket", "held", "rows")


@query(
    "state_version_differences",
    ["delivered"],
    f"""
    , before AS (SELECT {ITEM}, revision, payload_hash FROM delivered WHERE delivery < 3
                 QUALIFY row_number() OVER (PARTITION BY {ITEM}
                         ORDER BY revision DESC, batch_id, source_file, source_line) = 1),
    after AS (SELECT {ITEM}, revision, payload_hash FROM delivered
              QUALIFY row_number() OVER (PARTITION BY {ITEM}
                      ORDER BY revision DESC, batch_id, source_file, source_line) = 1)
    (SELECT 'missing' AS side, * FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after))
    UNION ALL
    (SELECT 'unexpected' AS side, * FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before))
    """,
)
def state_version_differences(spark, folder):
    found = _layouts(spark, folder)
    return B.version_differences(spark, found[2], found[3]).select(
        "side", *ITEM.split(", "), "revision", "payload_hash"
    )


@query(
    "state_map_fingerprint",
    ["state"],
    'SELECT count(*) AS "rows", TRUE AS agrees FROM state',
)
def state_map_fingerprint(spark, folder):
    last = _layouts(spark, folder)[-1]
    state = S.read_buckets(spark, last)
    whole = audit.table_fingerprint(state.select(*sorted(state.columns)))
    mine = B.map_fingerprint(S.read_map(spark, last.path, last.version))
    digests = ["rows", "digest_1", "digest_2"]
    return mine.join(whole.select(*digests, F.lit(True).alias("agrees")), digests, "left").select(
        "rows", F.coalesce("agrees", F.lit(False)).alias("agrees")
    )
