"""Cross-tokenizer alignment by galloping intersection of token ends.

Both tokenizers cut the same bytes (a blank and the text), so each gives a rising list of token
ends that closes with the text's length. The shorter list drives: each of its ends is looked for
in the longer one by doubling steps from where its rank suggests, then by halving (``gallop``, all
ends of a batch of texts at once). Ends found in both lists cut the tokens into groups; the
differences of the ranks found are the ranges of tokens that overlap.

- First pass over the texts (no shuffle): tokens, groups, links and, per document, its distinct
  linked id pairs with how often it links them. This rests as Parquet in the shared folder: the texts
  are tokenized once, and a lost executor repeats no more than its own part.
- A pair's count is the number of documents that hold it, combined before the shuffle; a first id's
  best count is a maximum over its pairs, at most as many as the second vocabulary has ids.
- The counts go back to the documents' pairs by a join. The table of counts is broadcast if it has at
  most ``BROADCAST_PAIRS`` rows (counted first; 17 bytes each), else both sides are shuffled by pair.

The vocabularies are files whose paths are parameters; the driver reads them and sends them to the
tasks (a few MB whatever the corpus). The byte-level vocabulary file is encoded by a merge engine
that is several times faster than the file's own library and gives the same ids (tested for every
code point), but for texts with an extremely long run of white space, which that library encodes.

Edge cases: texts that are null, empty, or whose joined token bytes are not a blank and the text
(say one with U+2581 in it) have no tokens: zeros and an empty ``groups_sha256``; special tokens in
a text are plain text; rows that repeat a doc_id are documents of their own; ties of counts are all
best; an empty table gives an empty result; other columns are ignored. A batch of texts of about
``CHUNK_BYTES`` is held at a time, a longer text alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import CHUNK_BYTES, ranges
from shelfwise.session import scratch_path

BROADCAST_PAIRS = 2_000_000
LONG_TEXT, LONG_BLANK = 200_000, re.compile(r"\s{100000}")

# Fixed value: the pattern of the byte-level vocabulary, which cuts a text before the merges.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + n): b for n, b in enumerate(other)}}


class ByteLevel:
    """Ids of texts by a byte-level BPE vocabulary (the JSON of the file)."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        made = json.loads(vocabulary)
        special = {t["id"] for t in made.get("added_tokens", ())}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.own = Tokenizer.from_str(vocabulary)
        self.own.encode_special_tokens = True
        self.pieces = [b""] * (1 + max(made["model"]["vocab"].values()))
        for piece, i in ranks.items():
            self.pieces[i] = piece

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.own.encode(t, add_special_tokens=False).ids
                if len(t) > LONG_TEXT and LONG_BLANK.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """Ids of texts by a sentence-piece model (the bytes of the file), which adds the blank itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_proto=model)
        ids = range(self.own.get_piece_size())
        self.pieces = [bytes([int(p[3:-1], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in ((i, self.own.id_to_piece(i)) for i in ids)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


def gallop(values: np.ndarray, longer: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """For each value the place of the first element of the sorted ``longer`` that is not less.

    From the hinted place the steps double until they pass the answer, then the bracket is halved.
    """
    n = len(longer)
    below = longer[hint] < values
    low, high = np.where(below, hint + 1, 0), np.where(below, n, hint)
    live, step = np.arange(len(values)), 1
    while live.size:
        probe = hint[live] + np.where(below[live], step, -step)
        inside = (probe >= 0) & (probe < n)
        live, probe = live[inside], probe[inside]
        less = longer[probe] < values[live]
        low[live[less]] = probe[less] + 1
        high[live[~less]] = probe[~less]
        live, step = live[less == below[live]], step * 2
    live = np.flatnonzero(low < high)
    while live.size:
        middle = (low[live] + high[live]) // 2
        less = longer[middle] < values[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
        live = live[low[live] < high[live]]
    return low


def intersect(drive: np.ndarray, n_drive: np.ndarray, longer: np.ndarray,
              n_longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of several texts laid end to end: for each driving token the first and the last token of
    the longer list that overlap it, and whether both lists end there."""
    local = np.arange(len(drive)) - np.repeat(np.cumsum(n_drive) - n_drive, n_drive)
    hint = (np.repeat(np.cumsum(n_longer) - n_longer, n_drive)
            + local * np.repeat(n_longer, n_drive) // np.repeat(np.maximum(n_drive, 1), n_drive))
    last = gallop(drive, longer, hint)
    common = longer[last] == drive
    first = np.zeros(len(drive), np.int64)
    first[1:] = last[:-1] + common[:-1]
    return first, last, common


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count


class Aligner:
    """The alignment of batches of texts under two vocabularies."""

    def __init__(self, vocabulary: str, model: bytes):
        self.a, self.b = ByteLevel(vocabulary), Pieces(model)
        self.size_b = len(self.b.pieces)
        self.sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in (self.a, self.b)]
        self.bytes = [np.array(t.pieces, object) for t in (self.a, self.b)]
        n = max(len(self.a.pieces), self.size_b)
        self.marks = {c: np.array([b"%d%c" % (i, ord(c)) for i in range(n)], object) for c in ",|;"}

    def whole(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Numbers of the texts that both tokenizers keep byte for byte, their ids and counts."""
        rows = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in rows]
        made = [self.a.encode(spaced), self.b.encode([texts[i] for i in rows])]
        want = [t.encode() for t in spaced]
        size = np.fromiter(map(len, want), np.int64, len(rows))
        fits = np.ones(len(rows), bool)
        flat = [_flat(m) for m in made]
        for side, (ids, count) in enumerate(flat):
            length = np.bincount(np.repeat(np.arange(len(rows)), count), self.sizes[side][ids], len(rows))
            if (length == size).all() and b"".join(self.bytes[side][ids].tolist()) == b"".join(want):
                continue
            fits &= [b"".join(self.bytes[side][some].tolist()) == w if some else False for some, w in zip(made[side], want)]
        if not fits.all():
            flat = [_flat([m for m, ok in zip(some, fits) if ok]) for some in made]
        return np.array(rows, np.int64)[fits], [ids for ids, _ in flat], [count for _, count in flat]

    def align(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct ``pairs`` and their ``times``."""
        n = len(texts)
        rows, ids, counts = self.whole(texts)
        out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests = np.full(n, "", object)
        out["n_a"][rows], out["n_b"][rows] = counts
        keys = []
        a_drives = counts[0] <= counts[1]
        for turn, some in ((False, np.flatnonzero(a_drives)), (True, np.flatnonzero(~a_drives))):
            if not len(some):
                continue
            keep = [np.repeat(a_drives != turn, c) for c in counts]
            token, count = [i[k] for i, k in zip(ids, keep)], [c[some] for c in counts]
            ends = [np.cumsum(s[t]) for s, t in zip(self.sizes, token)]
            d, o = (1, 0) if turn else (0, 1)
            first, last, common = intersect(ends[d], count[d], ends[o], count[o])
            owner = np.repeat(np.arange(len(some)), count[d])
            overlap = last - first + 1
            out["n_groups"][rows[some]] = np.bincount(owner, common, len(some))
            out["n_links"][rows[some]] = np.bincount(owner, overlap, len(some))
            linked = [None, None]
            linked[d], linked[o] = np.repeat(token[d], overlap), token[o][ranges(first, overlap)]
            keys.append(np.repeat(some[owner], overlap) * (len(self.a.pieces) * self.size_b)
                        + linked[0] * self.size_b + linked[1])
            closes = [None, None]  # the last token of each group, on both sides
            closes[d], closes[o] = np.flatnonzero(common), last[common]
            digests[rows[some]] = self._digests(token, count, closes)
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[new, len(key)])
        doc, pair = np.divmod(key[new], len(self.a.pieces) * self.size_b)
        held = np.zeros(n, np.int64)
        held[rows] = np.bincount(doc, minlength=len(rows))[:len(rows)]
        return {**out, "groups_sha256": digests, "held": held, "pairs": pair, "times": times}

    def _digests(self, token: list[np.ndarray], count: list[np.ndarray], closes: list[np.ndarray]) -> list[str]:
        """SHA-256 of each text's groups, written as their ids."""
        groups = len(closes[0])
        seq = np.empty(len(token[0]) + len(token[1]), object)
        for side, mark in ((0, "|"), (1, ";")):
            group = np.repeat(np.arange(groups), np.diff(np.r_[-1, closes[side]]))
            # Before a first id stand the second ids of earlier groups, before a second one the first ids of its own too.
            before = np.r_[-1, closes[1 - side]][group + side] + 1
            piece = self.marks[","][token[side]]
            piece[closes[side]] = self.marks[mark][token[side][closes[side]]]
            seq[np.arange(len(group)) + before] = piece
        stop = np.cumsum(count[0] + count[1])
        parts = seq.tolist()
        return [hashlib.sha256(b"".join(parts[s:e])[:-1]).hexdigest() for s, e in zip(np.r_[0, stop[:-1]].tolist(), stop.tolist())]


TOKENIZED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "pairs array<long>, times array<int>")


def _text_slices(texts: pa.Array) -> Iterator[slice]:
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends, row = np.cumsum(size), 0
    while row < len(size):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield slice(row, stop)
        row = stop


def tokenized(docs: DataFrame, vocabulary: str, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first pass: one row per document, with its linked id pairs (``a * size of B + b``)."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            for rows in _text_slices(batch.column(1)):
                aligner = aligner or Aligner(*sent.value)
                size = rows.stop - rows.start
                got = aligner.align(batch.column(1).slice(rows.start, size).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum(got["held"])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, size), *[pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(got["groups_sha256"], pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(got["pairs"], pa.int64())),
                     pa.ListArray.from_arrays(offsets, pa.array(got["times"].astype(np.int32)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, TOKENIZED)


def align(docs: DataFrame, vocabulary_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    with open(model_path, "rb") as f:
        model = f.read()
    size_b = len(Pieces(model).pieces)

    path = scratch_path(spark, "crosstok-documents")
    (tokenized(docs, vocabulary, model, doc_id, text).withColumn("_row", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(path))
    done = spark.read.parquet(path)

    counted = scratch_path(spark, "crosstok-counts")
    done.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).write.parquet(counted)
    counts = spark.read.parquet(counted)
    first = Window.partitionBy(F.floor(F.col("pair") / size_b))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(first))
    if spark.read.parquet(counted).count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)

    links = done.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = links.join(counts, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("n")).cast("long").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return done.join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
