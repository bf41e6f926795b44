"""Near-duplicate documents by BagMinHash signatures, banding, and verified multiset overlap.

A document is the bag of its five-word shingles (lower case, words are runs of non-blank
characters; a text of one to four words is one shingle). Two documents are linked if the Jaccard
similarity of their bags, sum of least counts over sum of greatest, is at least ``THRESHOLD``;
documents with one text are one. A document's class is its connected component, named by the
smallest doc_id.

Signatures. Every shingle carries an independent Poisson process of rate 1 on each unit level of
weight; a bag sees the levels below its count. Each point falls on a random signature component,
which keeps its earliest point; two bags agree there with a probability equal to their weighted
Jaccard similarity. The processes are hierarchical: levels are grouped in dyadic blocks whose
first point is drawn for the block as a whole and split down, point by point, to a unit level, so
a block whose first point comes after all components are filled costs one draw (``signatures``).

Search. Signatures are cut in ``BANDS`` bands of ``ROWS``; documents that agree on a band share a
bucket. A pair at the threshold misses all buckets with probability 3e-6. A bucket of n copies is
not expanded into pairs:

1. each document is verified against one leader, the smallest document of the bucket it shares
   most often; verified links give a first set of components (``verify``);
2. documents connected by buckets form a group; those outside a group's largest component are then
   compared to all of the group (``connect``), in cells of bounded size that skip pairs already
   connected and return found links only. So no candidate pair between components is left out,
   while near copies, being in one component by then, cost nothing. A pair whose signatures agree
   so rarely that a similarity of 0.8 is over five standard deviations off is not verified.

Both read only texts that share a bucket with another one, written once to the shared folder.
Leaders and members meet sorted by leader, and a leader of many gets a share of them per piece
(``PIECE``), so no task holds a whole group.

Edge cases: null text is empty; texts without words are equal to their exact copies only; a null
doc_id ranks last (a class of such documents only has a null id); different texts under one doc_id, or
under none, are documents of their own, equal ones are one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import NULL_ID, chunks, id_key, keyed_texts, mix64, shingle_hashes, word_hashes, words
from shelfwise.llm.components import components
from shelfwise.session import rested

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
LEAST_ESTIMATE = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / SIZE) ** 0.5
PIECE = 256
OWN_NODES = 1 << 62  # from here on: nodes of texts that share a doc_id or have none; doc_ids lie below


def bags(data: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of each distinct shingle, sorted by text and hash."""
    starts, stops, owner = words(data, ends)
    hashes = word_hashes(data, starts, stops)
    shingle, at = shingle_hashes(hashes, owner, size)
    texts = owner[at]
    number = np.bincount(owner, minlength=len(ends) - 1)
    short = np.flatnonzero((number > 0) & (number < size))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = [int(mix64(np.array([hash(tuple(hashes[f:f + number[t]].tolist())) & (1 << 64) - 1], np.uint64))[0])
                 for f, t in zip(first, short)]
        shingle, texts = np.r_[shingle, np.array(whole, np.uint64)], np.r_[texts, short]
    if not len(shingle):
        return texts, shingle, np.zeros(0, np.int64)
    order = np.lexsort((shingle, texts))
    shingle, texts = shingle[order], texts[order]
    new = np.flatnonzero(np.r_[True, (np.diff(texts) != 0) | (shingle[1:] != shingle[:-1])])
    return texts[new], shingle[new], np.diff(np.r_[new, len(shingle)])


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits of the mixed seed."""
    return ((mix64(seed) >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def _node(shingle: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The seed of a shingle's process on the levels [low, low + width)."""
    return mix64(shingle ^ mix64((low * 64 + np.log2(width).astype(np.int64)).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPLIT, _SIDE, _PLACE = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD1342543DE82EF95), np.uint64(0xAEF17502108EF2D9)


def signatures(texts: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int,
               size: int = SIZE) -> np.ndarray:
    """The BagMinHash signature (uint32, ``size`` columns) of each text; texts without shingles get 0."""
    best = np.full(n_texts * size, np.inf)
    weight = np.bincount(texts, count, n_texts)
    limit = np.divide(size * (np.log(size) + 3), weight, out=np.zeros(n_texts), where=weight > 0)
    wanting = weight > 0
    while wanting.any():
        _fill(best, texts[wanting[texts]], shingle[wanting[texts]], count[wanting[texts]], limit, size)
        filled = np.isfinite(best.reshape(n_texts, size)).all(axis=1)
        wanting &= ~filled
        limit *= 2
    best[~np.isfinite(best)] = 0
    return (mix64(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n_texts, size)


def _fill(best: np.ndarray, texts: np.ndarray, shingle: np.ndarray, count: np.ndarray, limit: np.ndarray,
          size: int) -> None:
    """Enters the points of all processes up to each text's ``limit`` into ``best``."""
    # Blocks of levels [0, 1), [1, 2), [2, 4), [4, 8), ... that begin below the count.
    blocks = np.ceil(np.log2(count)).astype(np.int64) + 1
    own = np.repeat(np.arange(len(texts)), blocks)
    block = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    width = np.maximum(low, 1)
    seed = _node(shingle[own], low, width)
    x = -np.log(_uniform(seed)) / width
    turn = np.zeros(len(own), np.uint64)
    while len(own):
        live = x <= limit[texts[own]]
        own, low, width, seed, x, turn = (a[live] for a in (own, low, width, seed, x, turn))
        unit = width == 1
        u = np.flatnonzero(unit)
        draw = seed[u] + turn[u] * _STEP
        place = (mix64(draw ^ _PLACE) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, texts[own[u]] * size + place, x[u])
        x[u] -= np.log(_uniform(draw + _STEP))
        turn[u] += np.uint64(1)
        w = np.flatnonzero(~unit)
        if not len(w):
            continue
        # The block's first point goes to one half; the other half's first comes later.
        half = width[w] // 2
        right = (mix64(seed[w] ^ _SIDE) & np.uint64(1)).astype(np.int64)
        other = x[w] - np.log(_uniform(seed[w] ^ _SPLIT)) / half
        lows = np.r_[low[w] + right * half, low[w] + (1 - right) * half]
        mine, times, halves = np.r_[own[w], own[w]], np.r_[x[w], other], np.r_[half, half]
        seen = lows < count[mine]
        mine, lows, times, halves = mine[seen], lows[seen], times[seen], halves[seen]
        own, low, width = np.r_[own[u], mine], np.r_[low[u], lows], np.r_[width[u], halves]
        seed = np.r_[seed[u], _node(shingle[mine], lows, halves)]
        x, turn = np.r_[x[u], times], np.r_[turn[u], np.zeros(len(mine), np.uint64)]


def _body() -> Column:
    """The digest of a whole text."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def sign(docs: DataFrame) -> DataFrame:
    """(_k, body, sig): the digest of each text and its signature (null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in chunks(batch):
                n = len(ends) - 1
                texts, shingle, count = bags(data, ends)
                signed = signatures(texts, shingle, count, n)
                some = np.bincount(texts, minlength=n) > 0
                sig = pa.array([s.tobytes() if any_ else None for s, any_ in zip(signed, some)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(rows.start, n) for i in (0, 1)] + [sig],
                                                 names=["_k", "body", "sig"])
    texts = keyed_texts(docs).select("_k", _body().alias("body"), F.lower("text").alias("text"))
    return texts.mapInArrow(run, "_k long, body binary, sig binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(key, rep): the bands of each signature, for bands that more than one document has."""
    bands = (reps.where("sig is not null")
             .select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b"))
             .select(F.xxhash64("b", F.substring("sig", F.col("b") * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("key"), "rep"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("_last")).where("lead < _last")
    return bands.join(shared.select("key", "lead").hint("merge"), "key")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags, given as sorted hashes and counts."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    least = np.minimum(a[1][at[both]], b[1][both]).sum() if both.any() else 0
    return float(least / max(1, a[1].sum() + b[1].sum() - least))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The (node, other) pairs whose documents' bags are similar enough, by (rep, text) rows.

    ``other`` leads: its members are dealt to pieces of about ``PIECE``, each with a copy of it.
    """
    sizes = pairs.groupBy("other").agg((F.count("*") / PIECE).cast("int").alias("_pieces"))
    members = pairs.join(sizes.hint("merge"), "other").select(
        F.col("node").alias("rep"), "other", F.pmod(F.xxhash64("node"), F.col("_pieces") + 1).cast("int").alias("piece"),
        F.lit(1).alias("member"))
    leaders = sizes.select(F.col("other").alias("rep"), "other",
                           F.explode(F.sequence(F.lit(0), F.col("_pieces"))).alias("piece"), F.lit(0).alias("member"))
    asked = members.unionByName(leaders).join(texts.select("rep", "text"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, led = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for rows, data, ends in chunks(batch):
                n = len(ends) - 1
                ks, others, member = (batch.column(i).slice(rows.start, n).to_pylist() for i in (0, 1, 3))
                for i, bag in enumerate(_split(data, ends)):
                    if not member[i]:
                        lead, led = others[i], bag
                    elif lead == others[i] and similarity(led, bag) >= threshold:
                        found.append((ks[i], others[i]))
            yield _links(found)
    return (asked.repartition("other", "piece").sortWithinPartitions("other", "piece", "member", "rep")
            .select("rep", "other", "piece", "member", "text").mapInArrow(run, "node long, other long").distinct())


def _split(data: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bag of each text: sorted hashes and counts."""
    owner, shingle, count = bags(data, ends)
    cut = np.searchsorted(owner, np.arange(len(ends)))
    return [(shingle[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)],
                                      names=["node", "other"])


def connect(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between different components of a group of candidates.

    ``members`` are (rep, grp, comp, sig, text). Documents outside the group's largest component
    are compared to all of the group, in cells of at most about ``PIECE`` by ``PIECE`` documents. A
    cell joins components as it finds links and compares no pair within one, so it returns
    fewer links than it holds documents.
    """
    comps = members.groupBy("grp", "comp").agg(F.count("*").alias("_n"))
    torn = (comps.groupBy("grp").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_main"), F.sum("_n").alias("_all"),
                                     F.max("_n").alias("_most"), F.count("*").alias("_comps"))
            .where("_comps > 1")
            .select("grp", "_main", (F.col("_all") / PIECE).cast("int").alias("_in"),
                    ((F.col("_all") - F.col("_most")) / PIECE).cast("int").alias("_out")))
    rows = members.join(torn.hint("merge"), "grp")
    place = [F.pmod(F.xxhash64("rep"), F.col(c) + 1).cast("int") for c in ("_out", "_in")]
    every = [F.explode(F.sequence(F.lit(0), F.col(c))) for c in ("_out", "_in")]
    columns = ["rep", "comp", "sig", "text"]
    outside = rows.where("comp <> _main").select("grp", place[0].alias("i"), every[1].alias("j"), F.lit(0).alias("side"), *columns)
    inside = rows.select("grp", place[1].alias("j"), every[0].alias("i"), F.lit(1).alias("side"), *columns)

    def cell(held: list[tuple]) -> list[tuple[int, int]]:
        """Links of a cell's (side, rep, comp, sig, bag) rows, those of side 0 against side 1."""
        out, all_ = ([x for x in held if x[0] == side] for side in (0, 1))
        if not out or not all_:
            return []
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        signed = np.frombuffer(b"".join(x[3] for x in all_), np.uint32).reshape(len(all_), -1)
        found = []
        for _, rep, comp, sig, bag in out:
            alike = (signed == np.frombuffer(sig, np.uint32)).mean(axis=1)
            for at in np.argsort(-alike, kind="stable"):
                if alike[at] < LEAST_ESTIMATE:
                    break
                other = all_[at]
                if find(comp) != find(other[2]) and similarity(bag, other[4]) >= threshold:
                    root[find(comp)] = find(other[2])
                    found.append((max(rep, other[1]), min(rep, other[1])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for rows_, data, ends in chunks(batch):
                some = batch.slice(rows_.start, len(ends) - 1)
                columns_ = [some.column(i).to_pylist() for i in range(7)]
                for *where, side, rep, comp, sig, bag in zip(*columns_, _split(data, ends)):
                    if where != at:
                        found += cell(held)
                        at, held = where, []
                    held.append((side, rep, comp, sig, bag))
            yield _links(found)
        yield _links(cell(held))
    dealt = outside.unionByName(inside).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "rep")
    return dealt.select("grp", "i", "j", "side", "rep", "comp", "sig", "text").mapInArrow(run, "node long, other long")


def _named(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, the root of ``rep`` (itself if it has no other)."""
    known = roots.select(F.col("node").alias("rep"), F.col("root").alias("_root")).hint("merge")
    return rows.join(known, "rep", "left").withColumn(name, F.coalesce("_root", "rep")).drop("_root")


def _nodes(signed: DataFrame) -> DataFrame:
    """(body, _doc, rep, sig): each text with its smallest doc_id, which is also its node unless another
    text has the same; texts that share theirs (or have none) get nodes of their own, from their digest."""
    reps = signed.groupBy("body").agg(F.min("_k").alias("_doc"), F.any_value("sig").alias("sig"))
    shared = reps.groupBy("_doc").agg(F.count("*").alias("_n")).where("_n > 1").select("_doc", F.lit(True).alias("_shared"))
    own = F.lit(OWN_NODES) + F.shiftrightunsigned(F.xxhash64("body"), 2)
    return (reps.join(shared, "_doc", "left")
            .select("body", "_doc", F.when(F.col("_shared"), own).otherwise(F.col("_doc")).alias("rep"), "sig"))


def _classed(docs: DataFrame) -> DataFrame:
    """(_k, body, class_id) of every row; a class has the smallest doc_id of its texts (``NULL_ID`` if none)."""
    signed = rested(sign(docs), "signatures")
    reps = rested(_nodes(signed), "nodes")
    met = rested(band_rows(reps).where("rep > lead").groupBy("rep", "lead").agg(F.count("*").alias("_n")), "met")

    # The texts that share a band with another one; all that follows reads only these.
    some = met.select("rep").union(met.select("lead")).distinct()
    texts = rested(
        reps.join(some.hint("merge"), "rep")
        .join(keyed_texts(docs).select(F.col("_k").alias("_doc"), _body().alias("body"), F.lower("text").alias("text")),
              ["_doc", "body"]).select("rep", "sig", "text"), "near-duplicates")

    # One leader each: of the leaders in its buckets, the one met most often.
    first = (met.groupBy("rep").agg(F.max(F.struct("_n", (-F.col("lead")).alias("_l"))).alias("_best"))
             .select(F.col("rep").alias("node"), (-F.col("_best._l")).alias("other")))
    links = rested(verify(first, texts), "links")

    # Then all that is connected by buckets, as far as it is not one component.
    groups = components(met.select(F.col("rep").alias("node"), F.col("lead").alias("other")))
    members = _named(_named(texts, groups, "grp"), components(links), "comp")
    roots = components(links.unionByName(connect(members)))

    named = _named(reps.select("body", "_doc", "rep"), roots, "comp")
    # Only texts with a node of their own can have a doc_id under their class's least node.
    low = named.where(F.col("rep") != F.col("_doc")).groupBy("comp").agg(F.min("_doc").alias("_low"))
    doc_of = F.when(F.col("comp") < OWN_NODES, F.col("comp"))
    named = named.join(low, "comp", "left").select(
        "body", F.coalesce(F.least(doc_of, F.col("_low")), F.lit(NULL_ID)).alias("class_id"))
    return signed.join(named.hint("merge"), "body").select("_k", "body", "class_id")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs``; equal class ids are near duplicates.

    A document is its doc_id and its text: different texts under one doc_id are documents of their own.
    """
    return _classed(docs).select(F.when(F.col("_k") != NULL_ID, F.col("_k")).alias("doc_id"),
                                 F.when(F.col("class_id") != NULL_ID, F.col("class_id")).alias("class_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of the smallest doc_id of each class."""
    first = _classed(docs).where("_k = class_id").select(F.col("_k").alias("_id"), F.col("body").alias("_b")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("_row"), id_key("doc_id").alias("_id"), text.alias("text"))
    return (keyed.select("_row", "_id", _body().alias("_b")).join(first, ["_id", "_b"], "left_semi").select("_row.*"))
