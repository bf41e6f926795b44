"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves and each half is quantised by a codebook of its own (k-means on at
most ``MAX_SAMPLE`` vectors); every vector is an entry of the cell of its two centroids. A query
walks through pairs of centroids by growing sum of their squared distances to its halves, taken
from a heap (``nearest_cells``), until the cells passed hold ``SHARE`` of all entries (at any size;
``k`` and the query's own at least, so that ``k`` are found where there are as many). All entries of these cells are reranked by exact distance.

``SHARE`` is high since distances of vectors without structure lie close together. Recall against
brute force, measured on the test tables, is in the README.

Scale. Codebooks and the number of entries per cell (``CENTROIDS`` squared) have a fixed size. Cells
in index order are packed in blocks of about ``BLOCK`` entries, and a cell of more (a vector that
many rows repeat) is cut in pieces by a hash of vec_id; queries are dealt to groups of about
``QUERIES``. Block and query group meet in one task, which returns each query's ``k`` best of the
block. So no task holds more than a block and a group, and rows sent on do not follow the number of
pairs compared.

Edge cases: vectors that are null, all zero, or hold a null or a non-finite component, have another
length than most, or a null vec_id, take no part; of query vectors that repeat a vec_id the least is
searched, and entries with the query's vec_id are left out; ties go to the smaller vec_id; with
fewer candidates than ``k`` all are returned; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CENTROIDS = 32
MAX_SAMPLE = 20_000
ROUNDS = 15
SHARE = 0.6
BLOCK, QUERIES = 8_192, 2_048

FOUND = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & whole & F.exists(v, lambda x: x != 0.0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else -1))


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * x @ centroids.T + (centroids * centroids).sum(1), 0.0)


def codebook(x: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """k-means centroids: seeded at distinct rows, ``ROUNDS`` of Lloyd; empty ones stay as they are."""
    distinct = np.unique(x, axis=0)
    pick = np.random.default_rng(seed).permutation(len(distinct))[:size]
    made = distinct[np.sort(pick)]
    for _ in range(ROUNDS):
        near = _distances(x, made).argmin(axis=1)
        number = np.bincount(near, minlength=len(made))
        total = np.zeros_like(made)
        np.add.at(total, near, x)
        made = np.where(number[:, None] > 0, total / np.maximum(number, 1)[:, None], made)
    return made


def nearest_cells(a: np.ndarray, b: np.ndarray, entries: np.ndarray, need: int) -> list[int]:
    """Cells by growing a[i] + b[j], from a heap, until they hold ``need`` entries; empty ones left out."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, pushed = [(a[first[0]] + b[second[0]], 0, 0)], {(0, 0)}
    found: list[int] = []
    got = 0
    while heap and got < need:
        _, i, j = heapq.heappop(heap)
        cell = int(first[i]) * len(b) + int(second[j])
        if entries[cell]:
            found.append(cell)
            got += int(entries[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (a[first[x]] + b[second[y]], x, y))
    return found


class Index:
    """The codebooks, the entries per cell, and the blocks the cells are packed in."""

    def __init__(self, vectors: DataFrame, centroids: int = CENTROIDS) -> None:
        self.vectors = vectors
        total = vectors.count()
        self.total = total
        if not total:
            return
        draw = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) / 1_000_000
        sample = vectors.where(draw < MAX_SAMPLE / total) if total > MAX_SAMPLE else vectors
        got = sample.limit(2 * MAX_SAMPLE).toArrow()
        if not got.num_rows:
            got = vectors.limit(MAX_SAMPLE).toArrow()
        x = _matrix(got.column("v"), got.num_rows)
        x = x[np.lexsort(x.T)]  # the same codebooks in whatever order the sample comes
        self.half = max(1, x.shape[1] // 2)
        self.books = [codebook(part, centroids) if part.shape[1] else np.zeros((1, 0))
                      for part in (x[:, :self.half], x[:, self.half:])]
        self.cells = len(self.books[0]) * len(self.books[1])
        self.entries = np.zeros(self.cells, np.int64)
        for row in self.assigned().groupBy("cell").count().collect():  # one row per cell
            self.entries[row["cell"]] = row["count"]
        self.pieces = 1 + self.entries // BLOCK
        size = np.ceil(self.entries / self.pieces)
        self.block = np.zeros(self.cells, np.int64)  # of a cell's first piece; further ones follow alone
        at, held = 0, 0
        for cell in range(self.cells):
            if self.pieces[cell] > 1:
                at += held > 0
                self.block[cell], at, held = at, at + self.pieces[cell], 0
                continue
            if held + size[cell] > BLOCK:
                at, held = at + 1, 0
            self.block[cell] = at
            held += size[cell]

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (_distances(x[:, :self.half], self.books[0]), _distances(x[:, self.half:], self.books[1]))

    def _light(self) -> Index:
        """Without the DataFrame, to travel to the tasks."""
        light = object.__new__(Index)
        light.__dict__ = {k: v for k, v in self.__dict__.items() if k != "vectors"}
        return light

    def assigned(self) -> DataFrame:
        """(vec_id, v, cell) of every vector."""
        index = self._light()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = index._halves(_matrix(batch.column(1), batch.num_rows))
                    cell = a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int64))],
                                                     names=["vec_id", "v", "cell"])
        return self.vectors.mapInArrow(run, "vec_id long, v array<double>, cell long")

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(vec_id, v, block, cells): the blocks a query visits and the cells it wants of each."""
        index = self._light()
        need = max(k + 1, int(np.ceil(SHARE * self.total)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, b = index._halves(_matrix(batch.column(1), batch.num_rows))
                rows, block, cells = [], [], []
                for i in range(batch.num_rows):
                    wanted: dict[int, list[int]] = {}
                    for cell in nearest_cells(a[i], b[i], index.entries, need):
                        for piece in range(int(index.pieces[cell])):
                            wanted.setdefault(int(index.block[cell]) + piece, []).append(cell)
                    rows += [i] * len(wanted)
                    block += wanted.keys()
                    cells += wanted.values()
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(block, pa.int64()),
                     pa.array(cells, pa.list_(pa.int64()))], names=["vec_id", "v", "block", "cells"])
        return queries.mapInArrow(run, "vec_id long, v array<double>, block long, cells array<long>")


def rerank(queries: np.ndarray, ids: np.ndarray, wanted: list[np.ndarray], x: np.ndarray, vec_id: np.ndarray,
           cell: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Query number, vec_ids and distances of the ``k`` nearest of a block's entries in wanted cells.

    A product of matrices finds candidates; those within rounding of the k-th are measured exactly.
    """
    cells, code = np.unique(cell, return_inverse=True)
    for low in range(0, len(queries), 256):
        some = queries[low:low + 256]
        near = _distances(some, x)
        margin = 1e-9 * (1.0 + (some * some).sum(1) + (x * x).sum(1).max())
        for i in range(len(some)):
            ok = np.isin(cells, wanted[low + i])[code] & (vec_id != ids[low + i])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            d = near[i, at]
            if len(at) > k:
                at = at[d <= np.partition(d, k - 1)[k - 1] + 2.0 * margin[i]]
            exact = np.sqrt(((x[at] - some[i]) ** 2).sum(axis=1))
            best = np.lexsort((vec_id[at], exact))[:k]
            yield low + i, vec_id[at][best], exact[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest entries of ``vectors`` to each of ``queries`` (both vec_id, embedding)."""
    index = Index(usable(vectors))
    if not index.total:
        return vectors.sparkSession.createDataFrame([], FOUND)
    width = index.half if len(index.books) < 2 else index.half + index.books[1].shape[1]
    asked = usable(queries).where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = 1 + asked.count() // QUERIES
    tables = [F.array(*[F.lit(int(n)) for n in some]) for some in (index.pieces, index.block)]
    piece = F.pmod(F.xxhash64("vec_id"), F.element_at(tables[0], (F.col("cell") + 1).cast("int")))
    entries = index.assigned().select(
        "vec_id", "v", "cell", (F.element_at(tables[1], (F.col("cell") + 1).cast("int")) + piece).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    wishes = index.visits(asked, k).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(wish: pa.Table, entry: pa.Table) -> pa.Table:
        if not wish.num_rows or not entry.num_rows:
            return schema.empty_table()
        x, q = _matrix(entry.column("v"), entry.num_rows), _matrix(wish.column("v"), wish.num_rows)
        ids, cells = np.asarray(wish.column("vec_id")), wish.column("cells").to_pylist()
        out = [(np.full(len(v), ids[i]), v, s) for i, v, s in rerank(
            q, ids, [np.array(c) for c in cells], x, np.asarray(entry.column("vec_id")), np.asarray(entry.column("cell")), k)]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    best = (wishes.groupBy("block", "group").cogroup(entries.groupBy("block", "group"))
            .applyInArrow(run, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
