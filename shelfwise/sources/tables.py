"""S-1 / S-2: read the six inventory tables with explicit schemas and clean zero dates.

A MariaDB-style zero date (``0000-00-00``) is not NULL: it sorts first, it is "before"
every date, and date differences of it are NULL. Ingest keeps that meaning as a NULL
date plus a ``<col>_zero`` flag; every predicate goes through ``functions.dates``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.sources import schemas

ZERO_DATE = "0000-00-00"


@dataclass(frozen=True)
class Inventory:
    """The six tables of the inventory database as DataFrames."""

    products: DataFrame
    batches: DataFrame
    movements: DataFrame
    sales: DataFrame
    sale_items: DataFrame
    users: DataFrame

    def with_(self, **tables: DataFrame) -> "Inventory":
        return replace(self, **tables)

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "products": self.products,
            "product_batches": self.batches,
            "batch_movements": self.movements,
            "sales": self.sales,
            "sale_items": self.sale_items,
            "users": self.users,
        }


def _as_text(col: str) -> Column:
    return F.trim(F.col(col).cast("string"))


def _zero(col: str) -> Column:
    return F.coalesce(_as_text(col).startswith(ZERO_DATE), F.lit(False))


def clean_dates(df: DataFrame, cols) -> DataFrame:
    """S-2: string date columns -> DATE plus a ``<col>_zero`` flag.

    ``try_cast`` maps the zero date (and any other unparsable text) to NULL without
    failing under ANSI mode; the flag records that the source held a zero date. Text that is
    no date is NULL here too; ``malformed_dates`` names it and ``split_dates`` keeps such rows apart.
    """
    return df.withColumns({**{f"{c}_zero": _zero(c) for c in cols},
                           **{c: F.expr(f"try_cast(trim(cast(`{c}` as string)) as date)") for c in cols}})


def malformed_dates(cols) -> Column:
    """S-2: ``column: text`` of every date column whose text is neither empty, a date, nor a zero date."""
    def fault(c: str) -> Column:
        text = _as_text(c)
        bad = (text != "") & ~_zero(c) & F.expr(f"try_cast(trim(cast(`{c}` as string)) as date)").isNull()
        return F.when(bad, F.concat(F.lit(f"{c}: "), text))
    return F.concat_ws("; ", *[fault(c) for c in cols])


def split_dates(df: DataFrame, cols) -> tuple[DataFrame, DataFrame]:
    """S-2: (rows whose dates could be read, cleaned; the others as they are, with ``reject_reason``)."""
    told = df.withColumn("reject_reason", malformed_dates(cols))
    return (clean_dates(told.where(F.col("reject_reason") == "").drop("reject_reason"), cols),
            told.where(F.col("reject_reason") != ""))


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order with its types; absent columns are NULL.

    Batch, movement and sale-item keys may be text or whole numbers. Numbers stay numbers (as
    BIGINT), so that 9 comes before 10 wherever a key breaks ties.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name in schemas.OPEN_KEYS and isinstance(present.get(f.name), T.IntegralType):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        elif f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name.endswith("_zero"):
            cols.append(F.lit(False).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(cols)


def conform(name: str, df: DataFrame) -> DataFrame:
    return _conform(df, schemas.SCHEMAS[name])


def _read(spark: SparkSession, path: str, fmt: str, name: str, numeric_keys: bool) -> tuple[DataFrame, list[str]]:
    """A table as it is stored, and its date columns that are text (all of them in CSV)."""
    location, schema = f"{path}/{name}.{fmt}", schemas.SCHEMAS[name]
    if fmt != "csv":
        raw = spark.read.parquet(location)
    else:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(location)
        for f in schema.fields:
            if f.name in raw.columns and isinstance(f.dataType, T.BooleanType) and not f.name.endswith("_zero"):
                raw = raw.withColumn(f.name, F.lower(F.col(f.name)).isin("1", "true"))
            if numeric_keys and f.name in raw.columns and f.name in schemas.OPEN_KEYS:
                raw = raw.withColumn(f.name, F.col(f.name).cast("long"))
    dates = [f.name for f in schema.fields if isinstance(f.dataType, T.DateType) and f.name in raw.columns
             and isinstance(raw.schema[f.name].dataType, T.StringType)]
    return raw, dates


def _inventory(tables: dict[str, DataFrame]) -> Inventory:
    return Inventory(
        products=tables["products"], batches=tables["product_batches"],
        movements=tables["batch_movements"], sales=tables["sales"],
        sale_items=tables["sale_items"], users=tables["users"],
    )


def load(spark: SparkSession, path: str, fmt: str = "parquet", numeric_keys: bool = False) -> Inventory:
    """S-1: read ``<path>/<table>.<fmt>`` for the six tables.

    Parquet is read with its own schema and conformed; CSV (the small golden fixture)
    is read as strings with the header and typed here; there ``numeric_keys`` says that batch,
    movement and sale-item keys are whole numbers. Dates that are text are cleaned in either format
    (what is no date becomes NULL; ``load_apart`` keeps such rows apart).
    """
    tables = {}
    for name, schema in schemas.SCHEMAS.items():
        raw, dates = _read(spark, path, fmt, name, numeric_keys)
        tables[name] = _conform(clean_dates(raw, dates) if dates else raw, schema)
    return _inventory(tables)


def load_apart(spark: SparkSession, path: str, fmt: str = "parquet",
               numeric_keys: bool = False) -> tuple[Inventory, dict[str, DataFrame]]:
    """As ``load``, but rows with a malformed date are not in the tables: they are returned by table as
    they are stored, with ``reject_reason``."""
    tables, apart = {}, {}
    for name, schema in schemas.SCHEMAS.items():
        raw, dates = _read(spark, path, fmt, name, numeric_keys)
        clean, apart[name] = split_dates(raw, dates) if dates else (raw, raw.withColumn("reject_reason", F.lit("")).where("false"))
        tables[name] = _conform(clean, schema)
    return _inventory(tables), apart
