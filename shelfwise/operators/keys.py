"""Keys of the rows a job adds to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.scan import running_count


def new_keys(rows: DataFrame, existing: DataFrame, key: str, order: Sequence[str], text: Column) -> DataFrame:
    """Add ``key`` to ``rows`` that join ``existing``.

    Whole-number keys go on after the largest existing one, in ``order`` (which must be
    unique); reruns give the same keys. In a table with text keys the key is ``text``.
    """
    if not isinstance(existing.schema[key].dataType, T.IntegralType):
        return rows.withColumn(key, text)
    top = existing.agg(F.max(key).alias("top")).first()["top"] or 0
    return (running_count(rows, [], order, "_nth")
            .withColumn(key, F.lit(top).cast("long") + F.col("_nth")).drop("_nth"))
