"""Hard-negative mining by slot-decomposed selection.

A row's score is its integer inner product with an anchor. Each of the anchor's positives has a
window of scores for its negatives, from ``low`` to ``high`` percent of the positive's score. The
positives' upper limits, in descending order, cut the scores into disjoint slots: slot ``s`` holds
the scores over the next lower limit and up to limit ``s``. A window that starts at limit ``s`` is
the union of the slots from ``s`` on, down to its own lower limit, so the first ``k`` negatives of
every slot are enough for all windows: tasks keep ``k`` per anchor and slot (a combiner, before any
shuffle of results), these are cut to ``k`` again, and merging them from the lowest slot upwards
gives each window's first ``k``.

The anchors against all rows is a stated query set against the whole table, done in cells of a
block of rows and a block of anchors. Rows are dealt to blocks evenly, whatever their ids, labels or
vectors, so no hot label or repeated vector makes a large cell; a cell's memory is bounded by
``ROWS``, ``ANCHORS`` and ``CHUNK``. Two rounds of cells run: one for the positives, one for the slots.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part;
shorter vectors count as filled up with zeros; an anchor's other rows are those of another
vec_id; rows repeated in full count once as anchors; anchors that share a vec_id but differ are
mined on their own; scores beyond 64 bits count as the nearest such number; ties go to the smaller
vec_id; an anchor without positives, and a positive whose window is empty, give no row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import scratch_path

ROWS, ANCHORS, CHUNK = 1 << 13, 1 << 14, 1 << 8
SCALE = 256.0
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    fit = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                           F.col(vector).alias("vector"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors' scaled whole-number components as float64 rows, filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    x = np.floor(SCALE * np.asarray(lists.flatten()).astype(np.float64))
    out = np.zeros((len(size), width))
    if len(x):
        out[np.arange(width) < size[:, None]] = x
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max([pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number rows, limited to 64 bits."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = np.dot(whole(a), whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def firsts(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's first ``k`` by falling score, then rising id, groups ascending."""
    order = np.lexsort((ident, ~score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


def limits(scores: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """Lower and upper limits of the windows of positives with these scores: the least and the
    greatest whole number ``n`` with ``low * s <= 100 * n <= high * s``."""
    return [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]


def slot_limits(scores: list[int], low: int, high: int) -> tuple[list[int], int]:
    """The distinct upper limits of the windows that are not empty, descending, and the least lower one."""
    some = [(a, b) for a, b in zip(*limits(scores, low, high)) if a <= b]
    return sorted({b for _, b in some}, reverse=True), min((a for a, _ in some), default=0)


def _cells(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int):
    """Rows and anchors, each copied to the cells of its block."""
    down, across = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    dealt = F.monotonically_increasing_id()
    left = rows.withColumn("_r", dealt % down).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = (anchors.withColumn("_c", (dealt % across).cast("int"))
             .withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")))))
    return left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c"))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n)) for n in names]


def positives(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, k: int) -> DataFrame:
    """(anchor, positive_id, positive_score): each anchor's first ``k`` other rows of its label."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            width = _width(left.column("vector"), right.column("vector"))
            x, y = _matrix(left.column("vector"), width), _matrix(right.column("vector"), width)
            ident, label = _columns(left, "vec_id", "label")
            own, key, mine = _columns(right, "vec_id", "_a", "label")
            for name in np.intersect1d(label, mine):
                some, theirs = np.flatnonzero(mine == name), np.flatnonzero(label == name)
                for at in range(0, len(some), CHUNK):
                    part = some[at:at + CHUNK]
                    score = inner(y[part], x[theirs])
                    other = ident[theirs][None] != own[part][:, None]
                    held = np.where(other, score, LONG.min)
                    nth = max(score.shape[1] - k, 0)
                    least = np.partition(held, nth, axis=1)[:, nth]
                    a, b = np.nonzero(other & (score >= least[:, None]))
                    pick = firsts(a, score[a, b], ident[theirs[b]], k)
                    a, b = a[pick], b[pick]
                    found.append((key[part[a]], ident[theirs[b]], score[a, b]))
        return _table(found, ["anchor", "positive_id", "positive_score"])
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return (_cells(rows, n_rows, anchors, n_anchors)
            .applyInArrow(run, "anchor long, positive_id long, positive_score long")
            .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k))


def slots(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, k: int, low: int, high: int) -> DataFrame:
    """(anchor, slot, negative_id, negative_score): the first ``k`` rows of another label in every
    slot of the anchors (with ``scores``, those of their positives)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            width = _width(left.column("vector"), right.column("vector"))
            x, y = _matrix(left.column("vector"), width), _matrix(right.column("vector"), width)
            ident, label = _columns(left, "vec_id", "label")
            key, mine = _columns(right, "_a", "label")
            cuts = [slot_limits(s, low, high) for s in right.column("scores").to_pylist()]
            # An anchor without windows gets limits that no score can meet.
            top = np.array([c[0] if c else LONG.min for c, _ in cuts])
            least = np.array([a if c else LONG.max for c, a in cuts])
            for at in range(0, len(key), CHUNK):
                part = slice(at, at + CHUNK)
                score = inner(y[part], x)
                a, b = np.nonzero((score <= top[part][:, None]) & (score >= least[part][:, None])
                                  & (label[None] != mine[part][:, None]))
                if not len(a):
                    continue
                value = score[a, b]
                # The slot is the number of limits over the score, less one: those under it do not count.
                most = max(len(c) for c, _ in cuts[part])
                ends = np.array([c + [LONG.min] * (most - len(c)) for c, _ in cuts[part]], np.int64)
                slot = (ends[a] >= value[:, None]).sum(axis=1) - 1
                pick = firsts(a * most + slot, value, ident[b], k)
                a, b = a[pick], b[pick]
                found.append((key[part][a], slot[pick], ident[b], value[pick]))
        return _table(found, ["anchor", "slot", "negative_id", "negative_score"])
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return (_cells(rows, n_rows, anchors, n_anchors)
            .applyInArrow(run, "anchor long, slot long, negative_id long, negative_score long")
            .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k))


def _table(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = list(zip(*found)) if found else [[] for _ in names]
    return pa.table([pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in columns], names)


def suffix_firsts(tops: dict[int, list[tuple[int, int]]], n_slots: int, k: int) -> list[list[tuple[int, int]]]:
    """For each slot the first ``k`` (score, id) of it and all lower ones, merged from the lowest up."""
    merged: list[list[tuple[int, int]]] = [[] for _ in range(n_slots + 1)]
    for slot in range(n_slots - 1, -1, -1):
        merged[slot] = sorted(merged[slot + 1] + tops.get(slot, []), key=lambda e: (-e[0], e[1]))[:k]
    return merged[:n_slots]


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50,
         high: int = 95) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows`` (both as ``usable`` gives them).

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "hardneg-anchors")  # numbers the anchors once and for all
    anchors.distinct().withColumn("_a", F.monotonically_increasing_id()).write.parquet(path)
    anchors = spark.read.parquet(path)
    n_rows, n_anchors = rows.count(), anchors.count()

    near = scratch_path(spark, "hardneg-positives")  # read by both the slots and the windows
    held = positives(rows, n_rows, anchors, n_anchors, n_positives)
    one = F.struct(F.col("_n").alias("n"), "positive_id", "positive_score")
    held.groupBy("anchor").agg(F.sort_array(F.collect_list(one)).alias("some")).write.parquet(near)
    held = spark.read.parquet(near)  # at most n_positives an anchor

    limited = anchors.join(held.select(F.col("anchor").alias("_a"), F.col("some.positive_score").alias("scores")), "_a")
    entry = F.struct("slot", "negative_score", "negative_id")
    tops = (slots(rows, n_rows, limited, n_anchors, n_negatives, low, high)
            .groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("tops")))  # n_positives * n_negatives at most

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for r in batch.to_pylist():
                by_slot: dict[int, list[tuple[int, int]]] = {}
                for e in r["tops"]:
                    by_slot.setdefault(e["slot"], []).append((e["negative_score"], e["negative_id"]))
                scores = [p["positive_score"] for p in r["some"]]
                ends, _ = slot_limits(scores, low, high)
                merged = suffix_firsts(by_slot, len(ends), n_negatives)
                for p, least, most in zip(r["some"], *limits(scores, low, high)):
                    if least <= most:
                        fit = [e for e in merged[ends.index(most)] if e[0] >= least]
                        out += [(r["vec_id"], p["positive_id"], n, e[1], p["positive_score"], e[0])
                                for n, e in enumerate(fit, 1)]
            types = [pa.int32() if n == "rank" else pa.int64() for n in names]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return (held.join(tops, "anchor").join(anchors.select(F.col("_a").alias("anchor"), "vec_id"), "anchor")
            .select("vec_id", "some", "tops")
            .mapInArrow(windows, "anchor_id long, positive_id long, rank int, negative_id long, "
                                 "positive_score long, negative_score long"))
