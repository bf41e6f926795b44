"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts and test items are words: runs of letters and digits, lower case. Runs of ``SEED`` words of
the items are seeds. A seed is *rare* if not many more documents have it than have the item's
seeds in general (``RARE`` times their median, or ``FEW``), counted over the whole corpus; at
least half of an item's seeds are rare, also if copies of the item fill the corpus. Where
``MIN_SEEDS`` rare seeds of an item stand close together in a document, the item is aligned to
that passage word by word (Smith-Waterman: ``MATCH`` for equal words, ``MISMATCH``, ``GAP``), so
edited, cut and paraphrased copies score by what is left of the wording. The score is the
alignment's, divided by that of an exact copy; from ``THRESHOLD`` on the document is a hit. So it is,
whatever the item's length, from an alignment on that is as good as ``VERBATIM`` words word for word
and has as many rare seeds as these: a long passage of a longer item is a copy too, a wording that
many documents have is not.

Scale. The corpus is the large side: it is read twice, once to count the seeds' documents
(combined map-side, one row per seed and batch) and once to find and align, without shuffling a
text. The items travel to the tasks in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark
takes more passes, not more memory. A passage in a third of all documents costs one alignment in
each, in the task that reads it.

Edge cases: null or empty texts have no hits; items of fewer than ``MIN_ITEM`` words, or null, take
no part, as such few words are no evidence; rows that repeat a doc_id or an item_id are handled one
by one; equal scores keep the earliest passage; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import chunks, mix64, raw_strings, word_hashes, words

SEED = 3
RARE, FEW = 4.0, 20
MIN_SEEDS = 2
MIN_ITEM = 5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
THRESHOLD = 0.5
VERBATIM = 13
BLOCK_WORDS = 1_000_000

# ASCII letters and digits stay, other ASCII becomes a blank, bytes of other characters stay.
_TEXT = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)

HITS = "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long"


def _word_rows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    data = _TEXT[data]
    starts, stops, owner = words(data, ends)
    return word_hashes(data, starts, stops), owner


def _seeds(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``SEED`` words within a text, and the first word's number."""
    n = len(hashes) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[SEED - 1:])
    value = np.zeros(len(at), np.uint64)
    for j in range(SEED):
        value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[at + j]
    return mix64(value), at


class Items:
    """A block of test items: their words, and their seeds sorted by hash."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
        hashes, owner = _word_rows(data, ends)
        number = np.bincount(owner, minlength=len(ids))
        self.ids = ids
        self.first = np.cumsum(number) - number
        self.length = number
        self.words = hashes
        seeds, at = _seeds(hashes, owner)
        use = number[owner[at]] >= MIN_ITEM
        seeds, at = seeds[use], at[use]
        order = np.argsort(seeds, kind="stable")
        self.grams, self.gram = np.unique(seeds[order], return_inverse=True)
        self.place = at[order]  # word number of each seed, by gram
        self.item = owner[self.place]

    def keep_rare(self, documents: np.ndarray) -> None:
        """Leaves the rare seeds only; ``documents`` counts each gram's documents."""
        n = documents[self.gram]
        order = np.lexsort((n, self.item))
        item = self.item[order]
        cut = np.flatnonzero(np.r_[True, np.diff(item) != 0])
        size = np.diff(np.r_[cut, len(item)])
        median = n[order][cut + (size - 1) // 2]
        most = np.zeros(len(self.ids))
        most[item[cut]] = np.maximum(FEW, RARE * median)
        rare = n <= most[self.item]
        self.place, self.item, self.gram = self.place[rare], self.item[rare], self.gram[rare]
        kept, self.gram = np.unique(self.gram, return_inverse=True)
        self.grams = self.grams[kept]

    def find(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the seeds that are grams of the block, and the grams."""
        if not len(self.grams) or not len(seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, seeds), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == seeds)
        return hit, at[hit]


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with many passages (rows, padded with 0): best score, and the
    first and last word of the passage it covers.

    One row of all matrices at a time; gaps along the row come from a running maximum.
    """
    n, width = passages.shape
    slope = GAP * np.arange(width + 1)
    above, origin = np.zeros((n, width + 1)), np.tile(np.arange(width + 1), (n, 1))
    best, first, last = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    columns = np.arange(width + 1)
    for word in item:
        diagonal = above[:, :-1] + np.where(passages == word, MATCH, MISMATCH)
        down = above[:, 1:] + GAP
        here, begun = np.zeros_like(above), np.tile(columns, (n, 1))
        here[:, 1:] = np.maximum(0.0, np.maximum(diagonal, down))
        begun[:, 1:] = np.where(here[:, 1:] <= 0, columns[1:], np.where(diagonal >= down, origin[:, :-1], origin[:, 1:]))
        lifted = here - slope
        run = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted >= run, columns, 0), axis=1)
        here = run + slope
        begun = begun[rows[:, None], source]
        top = here.argmax(axis=1)
        better = here[rows, top] > best
        best[better] = here[rows, top][better]
        first[better], last[better] = begun[rows, top][better], top[better] - 1
        above, origin = here, begun
    return best, first, last


def _candidates(items: Items, hit: np.ndarray, gram: np.ndarray, at: np.ndarray,
                owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, first word, last word, seeds) of the passages worth an alignment.

    Matches of an item in a text form one passage as long as each begins, if shifted to the item's
    start, within half the item's length of the one before.
    """
    low, high = np.searchsorted(items.gram, gram), np.searchsorted(items.gram, gram, side="right")
    reps = high - low
    pos = np.repeat(at[hit], reps)
    slot = np.repeat(low - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
    item, text = items.item[slot], owner[pos]
    begin = pos - (items.place[slot] - items.first[item])  # where the item would begin
    order = np.lexsort((pos, begin, item, text))
    text, item, begin, pos = text[order], item[order], begin[order], pos[order]
    length = items.length[item]
    new = np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(begin) > np.maximum(2, length[1:] // 2))]
    cut = np.flatnonzero(new)
    if not len(pos):
        return (np.zeros(0, np.int64),) * 5
    step = np.r_[True, (np.diff(pos) != 0)] | new
    seeds = np.add.reduceat(step.astype(np.int64), cut)
    start, stop = np.minimum.reduceat(begin, cut), np.maximum.reduceat(begin + length, cut)
    few = seeds < MIN_SEEDS
    return tuple(x[~few] for x in (text[cut], item[cut], start, stop, seeds))


def _hits(items: Items, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, score, seeds, first word, last word): the best hit of each pair in some texts."""
    hashes, owner = _word_rows(data, ends)
    seeds, at = _seeds(hashes, owner)
    found = items.find(seeds)
    text, item, start, stop, n = _candidates(items, *found, at, owner)
    if not len(text):
        return (np.zeros(0, np.int64),) * 6
    low = np.searchsorted(owner, np.arange(len(ends)))
    pad = items.length[item] // 4 + 1
    start, stop = np.maximum(start - pad, low[text]), np.minimum(stop + pad, low[text + 1])
    out = []
    order = np.lexsort((stop - start, item))
    groups = np.split(order, np.flatnonzero(np.diff(item[order])) + 1)
    for group in groups:
        own = items.words[items.first[item[group[0]]]:][:items.length[item[group[0]]]]
        for some in np.array_split(group, len(group) // 256 + 1):  # of similar widths
            if not len(some):
                continue
            width = int((stop[some] - start[some]).max())
            column = start[some][:, None] + np.arange(width)
            passages = np.where(column < stop[some][:, None], hashes[np.minimum(column, len(hashes) - 1)], np.uint64(0))
            score, first, last = align(own, passages)
            offset = start[some] - low[text[some]]
            out.append((text[some], item[some], score / (MATCH * len(own)), n[some], first + offset, last + offset))
    text, item, score, n, first, last = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((first, -score, item, text))
    text, item, score, n, first, last = (x[order] for x in (text, item, score, n, first, last))
    keep = np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0)] & (
        (score >= THRESHOLD) | (score * items.length[item] >= VERBATIM - 1e-9) & (n > VERBATIM - SEED))
    return tuple(x[keep] for x in (text, item, score, n, first, last))


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text is not null")
    total = texts.agg(F.sum(F.regexp_count("text", F.lit("\\S+")))).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_WORDS
    for i in range(blocks if total else 0):
        some = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).sort("item_id", "text").toArrow()
        if some.num_rows:
            data, ends = raw_strings(some.column("text").combine_chunks())
            ids = np.array([-1 if x is None else x for x in some.column("item_id").to_pylist()], np.int64)
            yield Items(ids, data[ends[0]:ends[-1]], ends - ends[0])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it contains a copy of (a null item_id is -1)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    found = [_block_hits(texts, _rare(texts, items)) for items in _blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], HITS)
    return reduce(DataFrame.unionByName, found)


def _rare(texts: DataFrame, items: Items) -> Items:
    """The block with its rare seeds only, by a count of every seed's documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(items.grams), np.int64)
            for _, data, ends in chunks(batch):
                hashes, owner = _word_rows(data, ends)
                seeds, at = _seeds(hashes, owner)
                hit, gram = items.find(seeds)
                pairs = np.unique(owner[at[hit]] * len(items.grams) + gram) if len(hit) else hit
                total += np.bincount(pairs % max(1, len(items.grams)), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    counted = texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    documents = np.zeros(len(items.grams), np.int64)
    for row in counted.collect():  # at most one row per gram of the block
        documents[row["gram"]] = row["n"]
    items.keep_rare(documents)
    return items


def _block_hits(texts: DataFrame, items: Items) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, data, ends in chunks(batch):
                text, item, score, n, first, last = _hits(items, data, ends)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + rows.start)), pa.array(items.ids[item]), pa.array(score.astype(np.float64)),
                     *(pa.array(x) for x in (n, first, last))],
                    names=["doc_id", "item_id", "score", "n_seeds", "first_word", "last_word"])
    return texts.mapInArrow(search, HITS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that have a hit."""
    lowered = F.lower(F.coalesce(F.col("text"), F.lit("")))
    for items in _blocks(benchmark):
        docs = _block_clean(docs, _rare(docs.select(lowered.alias("text")), items), lowered)
    return docs


def _block_clean(docs: DataFrame, items: Items, lowered: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for rows, data, ends in chunks(batch, "_lowered"):
                keep[_hits(items, data, ends)[0] + rows.start] = False
            yield batch.drop_columns(["_lowered"]).filter(pa.array(keep))
    return docs.withColumn("_lowered", lowered).mapInArrow(run, docs.schema)
