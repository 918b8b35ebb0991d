"""Column lists, row schemas and the fixed values of the delivery contract."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values of the contract -------------------------------------------------------
BUSINESS_FIELDS = [
    "source_system",
    "store_id",
    "sale_id",
    "line_id",
    "revision",
    "operation",
    "product_id",
    "sold_at",
    "quantity",
    "unit_price_brl",
    "line_discount_brl",
    "source_updated_at",
]
SALE_KEY = ["source_system", "store_id", "sale_id"]
ITEM_KEY = [*SALE_KEY, "line_id"]
REVISION_KEY = [*ITEM_KEY, "revision"]
OPERATIONS = ["UPSERT", "CANCEL"]
BUSINESS_ZONE = "America/Sao_Paulo"
MAX_REVISION = 2147483647
MAX_QUANTITY = 1000000
MAX_UNIT_PRICE = "999999999.99"
MAX_LINE_DISCOUNT = "9999999999999999.99"
DOCUMENT_VERSION = 1
PROFILE_CONTRACT_VERSION = 1
MAX_PROFILE_BYTES = 1048576

# Limits of the reports.
DAILY_LIMIT = 366
LISTING_LIMIT = 500
PRODUCT_LIMIT = 20
ISSUE_LIMIT = 50
RANKED_STORES = 6
MIX_PRODUCTS = 5
MATRIX_DAYS = 366
MATRIX_CELLS = 1200

# Limits of one delivery.
LIMIT_FILES = 1000
LIMIT_FILE_BYTES = 64 * 1024 * 1024
LIMIT_JSON_BYTES = 1024 * 1024
LIMIT_TOTAL_BYTES = 256 * 1024 * 1024

# Pipeline stages in the order they run, and how loud each severity is.
STAGE_ORDER = [
    "ingestion",
    "quality",
    "silver",
    "gold",
    "reconciliation",
    "publication",
    "complete",
]
SEVERITY_RANK = {"ERROR": 3, "BLOCKER": 3, "WARNING": 2, "INFO": 1}
TERMINAL_TYPES = {
    "PUBLISHED": "COMPLETE",
    "NO_CHANGE": "COMPLETE",
    "VALIDATED": "COMPLETE",
    "BLOCKED": "FAIL",
    "TECHNICAL_FAILURE": "FAIL",
}
PUBLISHED_TABLES = ["history", "silver", "gold_store_day", "gold_product_day", "bronze"]

# ---- Row schemas ------------------------------------------------------------------------
_PROVENANCE = [
    ("batch_id", T.StringType()),
    ("run_id", T.StringType()),
    ("source_file", T.StringType()),
    ("source_line", T.IntegerType()),
    ("payload_hash", T.StringType()),
    ("raw_payload", T.StringType()),
    ("errors", T.ArrayType(T.StringType())),
]

BRONZE = T.StructType(
    [T.StructField(name, T.StringType()) for name in BUSINESS_FIELDS]
    + [T.StructField(name, kind) for name, kind in _PROVENANCE]
)

TYPED_FIELDS = {
    "revision": "int",
    "quantity": "int",
    "unit_price_brl": "decimal(18,2)",
    "line_discount_brl": "decimal(18,2)",
    "sold_at": "timestamp",
    "source_updated_at": "timestamp",
}

ISSUE = "struct<code:string,severity:string,count:bigint,store_id:string,file:string,line:int>"
ATTEMPT = (
    "run_id string, batch_id string, state string, started_at string, finished_at string, "
    "duration_seconds double, stages map<string,double>, stats map<string,bigint>, "
    f"coverage map<string,array<string>>, issues array<{ISSUE}>, publication_id string, "
    "job_mode string"
)
TABLE_REFERENCE = "struct<path:string,version:bigint>"
SOURCE_REFERENCE = (
    "struct<batch_id:string,run_id:string,bronze_path:string,bronze_version:bigint,"
    "reference_hashes:map<string,string>,operator_reference_hash:string,manifest_hash:string>"
)
PUBLICATION = (
    "publication_id string, run_id string, published_at string, sequence bigint, "
    "previous_publication_id string, accepted_batches array<string>, "
    f"tables map<string,{TABLE_REFERENCE}>, sources array<{SOURCE_REFERENCE}>, "
    "profile struct<path:string,sha256:string,contract_version:int>"
)

# Column types of the published tables, as lineage events describe them.
BRONZE_TYPES = {
    **{name: "string" for name in BUSINESS_FIELDS},
    "batch_id": "string",
    "run_id": "string",
    "source_file": "string",
    "source_line": "integer",
    "payload_hash": "string",
    "raw_payload": "string",
    "errors": "array<string>",
}
STATE_TYPES = {
    **BRONZE_TYPES,
    "revision": "integer",
    "quantity": "integer",
    "unit_price_brl": "decimal(18,2)",
    "line_discount_brl": "decimal(18,2)",
    "sold_at": "timestamp",
    "source_updated_at": "timestamp",
    "business_date": "date",
    "line_net_brl": "decimal(24,2)",
}
GOLD_TYPES = {
    "net_revenue_brl": "decimal(28,2)",
    "units": "long",
    "item_lines": "long",
}
TABLE_TYPES = {
    "bronze": BRONZE_TYPES,
    "history": STATE_TYPES,
    "silver": STATE_TYPES,
    "gold_store_day": {
        "business_date": "date",
        "store_id": "string",
        **GOLD_TYPES,
        "sales_count": "long",
        "average_ticket_brl": "decimal(28,2)",
    },
    "gold_product_day": {"business_date": "date", "product_id": "string", **GOLD_TYPES},
}
