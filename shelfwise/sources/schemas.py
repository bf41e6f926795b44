"""Explicit schemas, enum domains and column defaults of the six inventory tables.

Keys are ``LongType``, but for those of ``OPEN_KEYS``: they are text in the tables derived from
the driver data and whole numbers in others, and the loaders keep what the source has.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

# ---- fixed values (must equal the reference's table definitions) ----------------
BATCH_STATUSES = ("available", "low_stock", "expired", "depleted")
MOVEMENT_TYPES = ("sale", "restock", "adjustment", "return", "expiry", "damage")
DISPOSAL_REASONS = ("expiry", "damage")
PAYMENT_METHODS = ("cash", "gcash")
USER_ROLES = ("admin", "staff")
USER_STATUSES = ("active", "inactive")
DEFAULT_REORDER_LEVEL = 50
DEFAULT_REORDER_QUANTITY = 100
LOW_STOCK_BATCH_UNITS = 10          # a batch at or below this is `low_stock`
PRODUCT_CATEGORIES = (
    "Prescription Medicines",
    "Over-the-Counter (OTC) Products",
    "Health & Personal Care",
    "Medical Supplies & Equipment",
)
# -----------------------------------------------------------------------------------

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("price", MONEY, False),
    T.StructField("current_stock", T.IntegerType(), False),
    T.StructField("manufactured_date", T.DateType(), True),
    T.StructField("expiry_date", T.DateType(), True),
    T.StructField("how_to_use", T.StringType(), True),
    T.StructField("side_effects", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("reorder_level", T.IntegerType(), True),
    T.StructField("reorder_quantity", T.IntegerType(), True),
    T.StructField("manufactured_date_zero", T.BooleanType(), False),
    T.StructField("expiry_date_zero", T.BooleanType(), False),
])

BATCHES = T.StructType([
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("batch_number", T.StringType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("original_quantity", T.IntegerType(), False),
    T.StructField("manufactured_date", T.DateType(), True),
    T.StructField("expiry_date", T.DateType(), True),
    T.StructField("supplier_name", T.StringType(), True),
    T.StructField("purchase_price", MONEY, True),
    T.StructField("received_date", T.DateType(), False),
    T.StructField("status", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("manufactured_date_zero", T.BooleanType(), False),
    T.StructField("expiry_date_zero", T.BooleanType(), False),
])

MOVEMENTS = T.StructType([
    T.StructField("movement_id", T.StringType(), False),
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("sale_item_id", T.StringType(), True),
    T.StructField("movement_type", T.StringType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("remaining_quantity", T.IntegerType(), False),
    T.StructField("movement_date", T.TimestampType(), False),
    T.StructField("notes", T.StringType(), True),
    T.StructField("performed_by", T.LongType(), True),
])

SALES = T.StructType([
    T.StructField("sale_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("customer_name", T.StringType(), True),
    T.StructField("total_amount", MONEY, False),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("amount_paid", MONEY, True),
    T.StructField("change_amount", MONEY, True),
    T.StructField("sale_date", T.TimestampType(), False),
    T.StructField("notes", T.StringType(), True),
])

SALE_ITEMS = T.StructType([
    T.StructField("sale_item_id", T.StringType(), False),
    T.StructField("sale_id", T.LongType(), False),
    T.StructField("line_no", T.IntegerType(), True),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("supp_id", T.LongType(), True),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("unit_price", MONEY, True),
    T.StructField("subtotal", MONEY, False),
    T.StructField("demand_date", T.DateType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("role", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
])

# Keys that are text in some sources and whole numbers in others; a source's numbers stay numbers.
OPEN_KEYS = ("batch_id", "movement_id", "sale_item_id")

SCHEMAS = {
    "products": PRODUCTS,
    "product_batches": BATCHES,
    "batch_movements": MOVEMENTS,
    "sales": SALES,
    "sale_items": SALE_ITEMS,
    "users": USERS,
}

# Primary and unique keys (I-1).
UNIQUE_KEYS = {
    "products": [("product_id",)],
    "product_batches": [("batch_id",), ("product_id", "batch_number")],
    "batch_movements": [("movement_id",)],
    "sales": [("sale_id",)],
    "sale_items": [("sale_item_id",)],
    "users": [("id",), ("username",)],
}

# Foreign keys (I-2): (child table, child column, parent table, parent column).
FOREIGN_KEYS = [
    ("batch_movements", "batch_id", "product_batches", "batch_id"),
    ("batch_movements", "sale_item_id", "sale_items", "sale_item_id"),
    ("batch_movements", "performed_by", "users", "id"),
    ("product_batches", "product_id", "products", "product_id"),
    ("sales", "user_id", "users", "id"),
    ("sale_items", "product_id", "products", "product_id"),
    ("sale_items", "sale_id", "sales", "sale_id"),
]

# Enum domains (I-3): (table, column, allowed values).
DOMAINS = [
    ("batch_movements", "movement_type", MOVEMENT_TYPES),
    ("products", "category", PRODUCT_CATEGORIES),
    ("product_batches", "status", BATCH_STATUSES),
    ("sales", "payment_method", PAYMENT_METHODS),
    ("users", "role", USER_ROLES),
    ("users", "status", USER_STATUSES),
]

# NOT NULL columns (I-4).
NOT_NULL = {
    "products": ["product_id", "product_name", "category", "price", "current_stock", "manufactured_date",
                 "expiry_date", "created_at", "updated_at"],
    "product_batches": ["batch_id", "product_id", "batch_number", "quantity", "original_quantity",
                        "manufactured_date", "expiry_date", "received_date", "created_at", "updated_at"],
    "batch_movements": ["movement_id", "batch_id", "movement_type", "quantity", "remaining_quantity",
                        "movement_date"],
    "sales": ["sale_id", "user_id", "total_amount", "sale_date"],
    "sale_items": ["sale_item_id", "sale_id", "product_id", "quantity", "unit_price", "subtotal", "created_at"],
    "users": ["id", "username"],
}
