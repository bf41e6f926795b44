"""Ordered scans per key (running sums and maxima, forward fill) that tolerate one huge key.

``Window.partitionBy(key).orderBy(...)`` sends a whole key group to one task; when a
product holds a third of all rows that task holds a third of the data. ``ordered_scan`` counts
the rows per key first: keys of up to ``ROWS_PER_TASK`` rows go through that window, one shuffle
and nothing written. Larger keys, and scans without a key, go through ``ranged_scan``, which
computes the same inclusive running values in two levels:

1. ``repartitionByRange`` on (keys, order) cuts the ordered data into contiguous
   ranges of similar size; a hot key is split across many ranges by its order columns.
2. Within each (range, key) piece a window computes local running values.
3. One summary row per (range, key) — at most #keys + #ranges rows — gets the totals
   of the preceding ranges of its key by a window over the range index (a hot key has
   at most one row per range there).
4. Local values plus the carry-in give the global running values. Only the first key of
   a range can go on from an earlier range, so at most one carry row per range is kept
   and broadcast: the data rows are not shuffled again.

The locally scanned data is checkpointed (reliable, in ``spark.checkpoint.dir``) before
the summary is taken. Range bounds are sampled per execution, so two plan branches that
each re-ran the range shuffle could disagree on which range a row is in; the checkpoint
fixes one assignment for both the summary and the final join, and cuts the lineage so
a lost executor does not force the scan to rerun from the sources.

The order columns must make the order total (end with a unique column); otherwise the
running value of tied rows is not defined, exactly as for a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import cut_lineage

_PART = "_scan_part"
# Rows of one key that one task scans (a window spills, so this bounds time, not memory); both ways give the same.
ROWS_PER_TASK = 1_000_000
# Counts of key hashes that a task sends, before any key is counted itself.
HASHES = 4096


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def large_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """The keys with more than ``most`` rows, or None if there are none.

    Rows are counted by a hash of their keys first, ``HASHES`` counts a task; only keys whose hash has more than
    ``most`` rows are counted themselves, so without large keys no key is shuffled.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HASHES))
    full = (df.groupBy(bucket.alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > most).select("_hash").collect())
    if not full:
        return None
    counted = df.where(bucket.isin([r["_hash"] for r in full])).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    large = cut_lineage(counted.select(*keys))
    return large if large.take(1) else None


def with_keys(df: DataFrame, keys: Sequence[str], large: DataFrame, how: str) -> DataFrame:
    """The rows of ``df`` whose keys are (``left_semi``) or are not (``left_anti``) in ``large``, at most one
    key a ``most`` rows. A NULL key is a key like others."""
    named = F.broadcast(large.select(*[F.col(k).alias(f"_large_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_large_{k}"))
    return df.join(named, same, how)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 sums: dict[str, Column] | None = None,
                 fills: dict[str, str] | None = None,
                 partitions: int | None = None, balanced: bool = False,
                 maxes: dict[str, Column] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Add inclusive running ``sums``, ``maxes`` and forward ``fills`` per ``keys`` in ``order``.

    Keys with more than ``ROWS_PER_TASK`` rows are scanned by ranges (all of them if ``partitions`` or
    ``balanced`` is given), the others by one window. ``counted`` has about as many rows a key as ``df``
    but is cheaper to count; it decides only which way a key goes.
    """
    keys, order = list(keys), list(order)
    if not keys or partitions or balanced:
        return ranged_scan(df, keys, order, sums, fills, partitions, balanced, maxes)
    if not sums and not fills and not maxes:
        return df
    large = large_keys(df if counted is None else counted, keys, ROWS_PER_TASK)
    if large is None:
        return windowed_scan(df, keys, order, sums, fills, maxes)
    return (windowed_scan(with_keys(df, keys, large, "left_anti"), keys, order, sums, fills, maxes)
            .unionByName(ranged_scan(with_keys(df, keys, large, "left_semi"), keys, order, sums, fills, maxes=maxes)))


def windowed_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None,
                  fills: dict[str, str] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """The running values by one window, a key in one task."""
    w = (Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({**{name: F.sum(expr).over(w) for name, expr in (sums or {}).items()},
                           **{name: F.max(expr).over(w) for name, expr in (maxes or {}).items()},
                           **{name: F.last(F.col(src), ignorenulls=True).over(w) for name, src in (fills or {}).items()}})


def ranged_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                sums: dict[str, Column] | None = None,
                fills: dict[str, str] | None = None,
                partitions: int | None = None, balanced: bool = False,
                maxes: dict[str, Column] | None = None) -> DataFrame:
    """The running values by ranges, whatever the size of a key.

    ``sums`` and ``maxes`` map an output name to a numeric expression; ``fills`` maps an output
    name to a column whose last non-NULL value (up to and including the row) is carried.
    ``balanced`` places the range pieces by range instead of by hash for the local
    window: a smaller largest task, at the price of one more sampling pass.
    """
    sums = sums or {}
    fills = fills or {}
    maxes = maxes or {}
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, order = list(keys), list(order)

    staged = df
    for name, expr in {**sums, **maxes}.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    ranged = (staged.repartitionByRange(n, *[F.col(c) for c in keys + order])
              .withColumn(_PART, F.spark_partition_id()))
    if balanced:
        # One range piece per task: range-partitioning on the range index itself keeps the
        # pieces apart (a hash of it would put several pieces of a hot key in one task) and
        # already satisfies the window's clustering on (range, keys).
        ranged = ranged.repartitionByRange(n, F.col(_PART))

    w_local = (Window.partitionBy(_PART, *keys).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(w_local))
    for name in maxes:
        local = local.withColumn(f"_l_{name}", F.max(f"_v_{name}").over(w_local))
    for name, src in fills.items():
        local = local.withColumn(f"_f_{name}", F.last(F.col(src), ignorenulls=True).over(w_local))

    if not sums and not fills and not maxes:
        return df
    local = cut_lineage(local)

    order_key = F.struct(*[F.col(c) for c in order])
    aggs = [F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    aggs += [F.max(f"_v_{name}").alias(f"_t_{name}") for name in maxes]
    aggs += [F.max_by(F.col(src), F.when(F.col(src).isNotNull(), order_key)).alias(f"_z_{name}")
             for name, src in fills.items()]
    summary = local.groupBy(_PART, *keys).agg(*aggs)
    # Without keys the summary has one row per range, so an unpartitioned window is small.
    w_carry = (Window.partitionBy(*keys) if keys else Window).orderBy(_PART) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        _PART, *keys,
        *[F.sum(f"_t_{name}").over(w_carry).alias(f"_o_{name}") for name in sums],
        *[F.max(f"_t_{name}").over(w_carry).alias(f"_o_{name}") for name in maxes],
        *[F.last(f"_z_{name}", ignorenulls=True).over(w_carry).alias(f"_c_{name}") for name in fills],
        F.count(F.lit(1)).over(w_carry).alias("_o_pieces"),
    ).where("_o_pieces > 0")
    out = local.join(F.broadcast(carry), [_PART, *keys], "left")
    for name in sums:
        before, here = F.col(f"_o_{name}"), F.col(f"_l_{name}")
        out = out.withColumn(name, F.coalesce(before + here, here, before))
    for name in maxes:
        out = out.withColumn(name, F.greatest(f"_o_{name}", f"_l_{name}"))   # skips NULLs
    for name in fills:
        out = out.withColumn(name, F.coalesce(F.col(f"_f_{name}"), F.col(f"_c_{name}")))
    helpers = [c for c in out.columns if c == _PART or c.startswith(("_v_", "_l_", "_f_", "_o_", "_c_"))]
    return out.drop(*helpers)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column,
                out: str, partitions: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    return ordered_scan(df, keys, order, sums={out: _col(value)}, partitions=partitions, counted=counted)


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                  partitions: int | None = None) -> DataFrame:
    """Row number per key in order (1-based), without one task per key."""
    return ordered_scan(df, keys, order, sums={out: F.lit(1).cast("long")}, partitions=partitions)
