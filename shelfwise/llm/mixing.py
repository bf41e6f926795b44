"""Mixing sources to target weights on a time-varying curriculum, with DataFrame functions only.

Sizes. A text's size is its number of blank-separated words. Sources rank by code point (null
last) and weigh 1, 2, 3, 1, 2, 3, ...; together they get as many words as the corpus has.

Targets. A source's target stops at ``max_repeat`` times its size; the excess goes to the others
by weight until none is above. That fixpoint is a water level: with sources ordered by
cap / weight, the ones below the level take their caps, the others level * weight.

Taking. Within a source, documents stand in the order of md5(doc_id); the mix walks that order
epoch after epoch until it has the target's words, so a document's words are taken
floor(target / source size) times and, in the last epoch, as far as the remainder reaches.

Curriculum. Over training time t in [0, 1] source weights change linearly: a source's share of
its own demand has the density ``1 + slope * (1 - 2 t)``, slope in [-1, 1] falling from +1 for the
first source to -1 for the last, so early sources come early. Its integral, the cumulative
demand ``D(t) = t + slope * t * (1 - t)``, is inverted in closed form: epoch e reads a document's
words from e * (source size) + (the words of its source before it) on, and that running count of the
source's taken words, divided by its target, is the share at which the demand is inverted. That is the
training position of the reading. So a source delivers over all of the run, whatever its target, and what
is not taken has no position. ``curriculum`` has a row for every document, range-sorted by its first
position; ``readings`` a row for every reading, range-sorted by its own.

Running sums within a source never need a whole source in one task: md5 prefixes cut each source
into ``BUCKETS`` blocks (by construction of similar size), block totals are combined map-side,
and only those totals (sources x BUCKETS rows) are summed up over a source.

Edge cases: null text has size 0; a null source is a source of its own, ranked last; a null
doc_id is ordered by the md5 of the empty text; rows that repeat a doc_id are told apart by their
text's md5, and equal rows have equal results up to the order among themselves; sources without
words get target 0; documents without taken words have no position and come last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_REPEAT = 3
BUCKET_CHARS = 3  # hex digits of md5: 4096 blocks a source
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, the never-null source key (_none, _source) and the place ``_at`` in its order."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("_none"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
                 F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("_at"),
    )


def targets(by_source: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds target and slope to (_none, _source, source_size), which has one row per source."""
    everything = Window.partitionBy()
    weighed = (by_source
               .withColumn("_rank", F.row_number().over(Window.orderBy("_none", "_source")))
               .withColumn("_sources", F.count("*").over(everything))
               .withColumn("_weight", (F.col("_rank") - 1) % 3 + 1)
               .withColumn("_cap", F.col("source_size") * F.lit(max_repeat))
               .withColumn("_fill", F.col("_cap") / F.col("_weight")))
    order = Window.orderBy("_fill", "_rank")
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The level if every source before this one is at its cap and none from here on is.
    tried = weighed.withColumn("_level", (F.sum("source_size").over(everything) - capped) / others)
    # The first source, in this order, that stays below its cap sets the level of all after it.
    fits = F.col("_level") * F.col("_weight") <= F.col("_cap")
    water = F.min(F.when(fits, F.struct("_fill", "_rank", "_level"))).over(everything)
    return tried.withColumn("_water", water["_level"]).select(
        "_none", "_source", "source_size",
        F.least(F.col("_cap").cast("double"), F.col("_water") * F.col("_weight")).alias("target"),
        F.when(F.col("_sources") > 1, F.lit(1.0) - F.lit(2.0) * (F.col("_rank") - 1) / (F.col("_sources") - 1))
        .otherwise(F.lit(0.0)).alias("slope"))


def _placed(docs: DataFrame, max_repeat: int) -> DataFrame:
    """``sizes`` with source_size, target, slope and ``_start``, the words of the source before the document."""
    block = ["_none", "_source", "_bucket"]
    sized = sizes(docs).withColumn("_bucket", F.substring("_at", 1, BUCKET_CHARS))
    blocks = sized.groupBy(*block).agg(F.sum("size").alias("_words"))
    goals = targets(blocks.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size")), max_repeat)
    running = F.sum("_words").over(Window.partitionBy("_none", "_source").orderBy("_bucket"))
    plan = blocks.withColumn("_before", running - F.col("_words")).drop("_words").join(goals, ["_none", "_source"])
    within = Window.partitionBy(*block).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (sized.join(plan, block)
            .withColumn("_start", F.col("_before") + F.sum("size").over(within) - F.col("size")))


def _inverse(share: Column) -> Column:
    """The time at which the cumulative demand reaches a share.

    Smaller root of slope * t^2 - (1 + slope) * t + share = 0, in its cancellation-free form.
    """
    b = F.lit(1.0) + F.col("slope")
    root = 2 * share / (b + F.sqrt(F.greatest(b * b - 4 * F.col("slope") * share, F.lit(0.0))))
    return F.when(share > 0, F.least(root, F.lit(1.0))).otherwise(F.lit(0.0))


def mix(docs: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, positions: one row per document.

    ``positions`` has a training position for each reading, ``position`` is the first (null if never read).
    """
    placed = _placed(docs, max_repeat)
    goal = F.round(F.col("target")).cast("long")
    words = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(goal / words)
    last = F.least(F.col("size"), F.greatest(goal - epochs * words - F.col("_start"), F.lit(0)))

    def begin(epoch: Column) -> Column:
        return epoch * F.col("source_size") + F.col("_start")

    every = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(goal / words).cast("long") - 1, F.lit(0)))
    read = F.filter(every, lambda e: (F.col("size") > 0) & (begin(e) < goal))
    positions = F.transform(read, lambda e: _inverse(F.least(begin(e) / F.greatest(goal, F.lit(1)), F.lit(1.0))))
    return (placed.withColumn("positions", positions)
            .select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"),
                    F.get("positions", F.lit(0)).alias("position"), "positions"))


def readings(docs: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, epoch, taken, position: one row per reading, in training order."""
    goal = F.round(F.col("target")).cast("long")
    begin = F.col("epoch") * F.col("source_size") + F.col("_start")
    epochs = F.ceil(goal / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    read = (_placed(docs, max_repeat).where((F.col("size") > 0) & (goal > 0))
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
            .withColumn("taken", F.least(F.col("size"), goal - begin)).where("taken > 0")
            .withColumn("position", _inverse(F.least(begin / goal, F.lit(1.0))))
            .select("doc_id", "size", "source_size", "target", "epoch", "taken", "position"))
    return read.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def curriculum(docs: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``mix`` range-sorted by first training position (ties by doc_id, documents that are not read last)."""
    mixed = mix(docs, max_repeat)
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
