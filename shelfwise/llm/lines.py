"""Line dedup with sharded cuckoo filters backed by exact reference counts; reversible.

A line's key is the line with ASCII blanks stripped at both ends and A-Z lower-cased; keys under
``MIN_CHARS`` code points never count. A key held by two documents or more is *repeated*: all its
lines go, except in the smallest doc_id holding it (where each of its lines stays).

The index is a table of exact reference counts, ``(key, refs, first)``: how many documents hold a
key, and the smallest of them. Beside it stands one cuckoo filter per shard of the key space with
the fingerprints of the repeated keys. ``insert`` adds documents to the counts, ``delete`` takes
documents off again; ``update_filters`` then adds the fingerprints of keys that became repeated
and deletes those of keys that no longer are, which a cuckoo filter, unlike a Bloom filter, can.

``dedup`` sends each (key, document) row to its shard, where the filter turns away nearly all keys
that are not repeated; only what passes is joined to the exact counts, which undo false positives.

Skew. Counting combines map-side. A key held by a third of all documents lies in one shard, so the
probe deals every shard to ``SALTS`` pieces by document; the exact join has unique keys on one
side and Spark can split the other.

Edge cases: a null or empty text is one empty line; a null doc_id is one document that ranks last;
rows that repeat a doc_id are parts of one document; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import id_key, keyed_texts
from shelfwise.session import cut_lineage

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
SHARD_KEYS = 50_000  # repeated keys a filter is sized for
SALTS = 16

DEDUPED = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may sit in either of two buckets.

    Equal fingerprints may be stored more than once, so each insert can be deleted once.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 0, blob: bytes | None = None) -> None:
        if blob is not None:
            self.table = np.frombuffer(blob, np.uint16).reshape(-1, self.SLOTS).copy()
        else:
            self.table = np.zeros((1 << max(0, buckets - 1).bit_length(), self.SLOTS), np.uint16)
        self.mask = len(self.table) - 1

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter that holds ``keys``, at most about half full; larger if one does not fit."""
        buckets = max(1, len(keys) // 2)
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets = 2 * len(made.table)

    @staticmethod
    def _hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket hash and fingerprint (never 0) from the first 12 bytes of each digest."""
        return keys[:, 0].astype(np.int64), (keys[:, 1] % 65535 + 1).astype(np.int64)

    @staticmethod
    def _parts(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(k[:8] for k in keys), np.uint32).reshape(-1, 2)

    def _other(self, bucket, mark):
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _place(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return bool(len(free))

    def insert(self, key: bytes) -> bool:
        """Whether there was room; if not, the filter must be rebuilt from the exact counts."""
        first, mark = (int(x[0]) for x in self._hash(self._parts([key])))
        bucket = first & self.mask
        if self._place(bucket, mark) or self._place(self._other(bucket, mark), mark):
            return True
        for kick in range(self.KICKS):
            slot = (kick * 7 + mark) % self.SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            if self._place(bucket, mark):
                return True
        return False

    def delete(self, key: bytes) -> bool:
        first, mark = (int(x[0]) for x in self._hash(self._parts([key])))
        for bucket in (first & self.mask, self._other(first & self.mask, mark)):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        first, mark = self._hash(self._parts(keys))
        bucket = first & self.mask
        other = self._other(bucket, mark)
        found = (self.table[bucket] == mark[:, None]) | (self.table[other] == mark[:, None])
        return found.any(axis=1)

    def blob(self) -> bytes:
        return self.table.tobytes()


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, or None if the key is too short to count."""
    key = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8")) < MIN_CHARS:
        return None
    return hashlib.md5(key).digest()


def line_keys(docs: DataFrame) -> DataFrame:
    """(key, _k): the distinct line keys of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            owners: list[int] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {line_key(x) for x in text.as_buffer().to_pybytes().split(b"\n")}
                own.discard(None)
                keys.extend(own)
                owners.extend([k] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())],
                                             names=["key", "_k"])
    return keyed_texts(docs).select("_k", "text").mapInArrow(run, "key binary, _k long")


def build(docs: DataFrame) -> DataFrame:
    """The reference counts (key, refs, first) of a corpus; a doc_id in two rows counts twice."""
    return line_keys(docs).groupBy("key").agg(F.count("*").alias("refs"), F.min("_k").alias("first"))


def insert(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The index with documents added; their ids must be new to it."""
    return (index.unionByName(build(docs)).groupBy("key")
            .agg(F.sum("refs").cast("long").alias("refs"), F.min("first").alias("first")))


def delete(index: DataFrame, docs: DataFrame, rest: DataFrame) -> DataFrame:
    """The index without ``docs``; ``rest`` are the documents that stay.

    Counts go down by the deleted documents' own. Only keys whose first holder went need the rest
    of the corpus, to find their new first holder.
    """
    gone = build(docs).select("key", F.col("refs").alias("_less"), F.col("first").alias("_was"))
    left = (index.join(gone, "key", "left")
            .withColumn("refs", (F.col("refs") - F.coalesce("_less", F.lit(0))).cast("long")).where("refs > 0"))
    orphans = left.where("_was = first").select("key")
    heirs = line_keys(rest).join(orphans, "key", "left_semi").groupBy("key").agg(F.min("_k").alias("_heir"))
    return (left.join(heirs, "key", "left")
            .select("key", "refs", F.coalesce("_heir", "first").alias("first")))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def shard_count(index: DataFrame) -> int:
    """Shards such that each filter holds about ``SHARD_KEYS`` repeated keys."""
    return 1 + index.where("refs > 1").count() // SHARD_KEYS


def build_filters(index: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter of each shard's repeated keys."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        made = CuckooFilter.of(rows.column("key").to_pylist())
        return pa.table({"shard": [key[0].as_py()], "filter": [made.blob()]},
                        schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary())]))
    repeated = index.where("refs > 1").select(_shard(shards), "key")
    return repeated.groupBy("shard").applyInArrow(run, "shard int, filter binary")


def update_filters(filters: DataFrame, old: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """The filters after the index went from ``old`` to ``new``: inserts and deletes fingerprints."""
    was = old.where("refs > 1").select("key", F.lit(True).alias("_old"))
    now = new.where("refs > 1").select("key", F.lit(True).alias("_new"))
    changed = (was.join(now, "key", "full").where("_old is null or _new is null")
               .select(_shard(shards), "key", F.col("_new").isNotNull().alias("add")))

    def run(key: tuple[pa.Scalar, ...], held: pa.Table, change: pa.Table) -> pa.Table:
        blobs = held.column("filter").to_pylist()
        made = CuckooFilter(blob=blobs[0]) if blobs else CuckooFilter(max(1, change.num_rows))
        shard = key[0].as_py()
        rows = list(zip(change.column("key").to_pylist(), change.column("add").to_pylist()))
        fits = all([made.delete(k) for k, add in rows if not add]) and all([made.insert(k) for k, add in rows if add])
        if not fits:
            raise RuntimeError(f"the filter of shard {shard} is full: rebuild it with build_filters")
        return pa.table({"shard": [shard], "filter": [made.blob()]},
                        schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary())]))
    return (filters.groupBy("shard").cogroup(changed.groupBy("shard"))
            .applyInArrow(run, "shard int, filter binary"))


def probe(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The (key, _k) rows whose key may be repeated, by the filter of the key's shard.

    Rows and filters are dealt by (shard, salt) and sorted, filter first, so that a task streams
    through its rows and holds one filter at a time.
    """
    rows = keys.select(_shard(shards), F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int").alias("salt"),
                       F.lit(None).cast("binary").alias("filter"), "key", "_k")
    dealt = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "filter",
                           F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("_k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            shard, blob = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            keys, owners = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            start, out = 0, []
            while start < len(shard):
                if blob[start] is not None:
                    held, at = CuckooFilter(blob=blob[start]), shard[start]
                    start += 1
                    continue
                stop = start
                while stop < len(shard) and blob[stop] is None and shard[stop] == shard[start]:
                    stop += 1
                if held is not None and at == shard[start]:
                    out.extend((start + np.flatnonzero(held.contains(keys[start:stop]))).tolist())
                start = stop
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in out], pa.binary()),
                                              pa.array([owners[i] for i in out], pa.int64())], names=["key", "_k"])
    both = rows.unionByName(dealt)
    return (both.repartition("shard", "salt").sortWithinPartitions("shard", F.col("filter").isNull(), "salt")
            .select("shard", "salt", "filter", "key", "_k").mapInArrow(run, "key binary, _k long"))


def dedup(docs: DataFrame, index: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """One row per document: what stays of it after every repeated key's later lines went."""
    joined = _marked(keyed_texts(docs), docs, index, filters, shards).select("doc_id", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                            ("kept_text", pa.string()), ("kept_sha256", pa.string())])
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some, rows = batch.slice(part, 512), []
                for doc_id, text, drop in zip(some.column(0).to_pylist(), some.column(1), some.column(2).to_pylist()):
                    held, kept = _kept(text, drop)
                    rest = b"\n".join(kept)
                    rows.append((doc_id, len(held), len(held) - len(kept), rest.decode("utf-8"),
                                 hashlib.sha256(rest).hexdigest()))
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
    return joined.mapInArrow(run, DEDUPED)


def _marked(texts: DataFrame, docs: DataFrame, index: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``texts`` (with _k) and the repeated keys each document is not the first holder of."""
    maybe = probe(line_keys(docs), filters, shards)
    repeated = index.where("refs > 1").select("key", "first")
    drops = (maybe.join(repeated.hint("merge"), "key").where("_k <> first")
             .groupBy("_k").agg(F.collect_set("key").alias("drop")))
    return texts.join(drops, "_k", "left")


def _kept(text: pa.Scalar, drop: list[bytes] | None) -> tuple[list[bytes], list[bytes]]:
    """All lines of a text, and those that stay."""
    held = text.as_buffer().to_pybytes().split(b"\n")
    if not drop:
        return held, held
    gone = set(drop)
    return held, [x for x in held if line_key(x) not in gone]


def indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The repeated keys of a corpus, their filters, and the number of shards.

    The keys are written to the shared checkpoint folder: the count that sizes the shards, the
    filters and the exact join all read them.
    """
    index = cut_lineage(build(docs).where("refs > 1"))
    shards = shard_count(index)
    return index, build_filters(index, shards), shards


def dedup_corpus(docs: DataFrame) -> DataFrame:
    """Index a corpus, build its filters, and dedup it against them."""
    return dedup(docs, *indexed(docs))


def rewrite(docs: DataFrame) -> DataFrame:
    """The rows of a corpus (doc_id, text, lang, source, n_chars) with their remaining text.

    ``n_chars`` is the new length; documents that lost all their lines are left out.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    texts = docs.select(id_key("doc_id").alias("_k"), *columns)
    joined = _marked(texts, docs, *indexed(docs)).select(*columns, "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keep = [], []
            for old, drop in zip(batch.column("text"), batch.column("drop").to_pylist()):
                kept = _kept(old, drop)[1] if drop else None
                text.append(old.as_py() if kept is None else b"\n".join(kept).decode("utf-8"))
                keep.append(kept is None or bool(kept))
            changed = [pa.array(text, pa.string()) if name == "text"
                       else pa.array([None if x is None else len(x) for x in text], pa.int64()) if name == "n_chars"
                       else batch.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays(changed, names=columns).filter(pa.array(keep))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return joined.select([F.col(c).cast(t) for c, t in (x.split() for x in schema.split(", "))] + ["drop"]).mapInArrow(run, schema)
