"""Substring dedup by hashing paragraphs and sentences: global digests, first occurrence kept, offsets retained.

A text is cut into units, the sentences of its lines: each run without ``. ! ?`` (``。！？``) or a line
break, together with the marks and blanks that end it. Units cover the whole text. A unit's key is
its wording: end marks off, blanks collapsed, lower case. A unit is *repeated* if its key stands
earlier, in a smaller doc_id or before it in the text; a repeated line is repeated unit by unit. Units
whose end has two line breaks end a paragraph, whose key is its units' keys in order.

Removed are

- the units of a repeated paragraph, whatever its length (a copied text is one, or several);
- every run of neighbouring repeated units with ``MIN_RUN`` code points of wording or more, whether
  these are a long sentence, some lines, or many short ones.

A shorter run inside a new paragraph stays, as short sentences repeat by chance. The first occurrence of a key is
never repeated, so no wording is lost. Repeats are judged on the input.

1. ``unit_keys`` emits one (key digest, document) row for each distinct key of a document: its units,
   and its paragraphs under ``MIN_RUN`` (longer ones are runs anyway). They are written once.
2. ``later_holders`` finds the first document of each key with a grouping that combines map-side
   (a key in a third of all documents costs one row per task), and joins the rows back to it;
   that join has unique keys on one side, so Spark can split a hot key of the other.
3. ``remove`` gets each text with the digests that belong to earlier documents, judges its units, and
   reports the removed spans as offsets into the original.

Edge cases: a null text is empty (no units); units without wording (marks, blank lines) count as
repeated without adding to a run; a null doc_id is one document that ranks last; rows that repeat
a doc_id are parts of one document, and each row is reported; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keyed_texts
from shelfwise.session import scratch_path

_BLANK = " \t\n\x0b\x0c\r"
_MARKS = ".!?。！？"
UNIT = re.compile(f"[^{_MARKS}\\n]*[{_MARKS}\\n][{_MARKS}{_BLANK}]*|[^{_MARKS}\\n]+")
_BLANKS = re.compile(f"[{_BLANK}]+")
MIN_RUN = 100

KEYS = "key binary, _k long"
REMOVED = ("doc_id long, n_units long, n_removed long, n_chars_removed long, "
           "spans array<struct<start:long,stop:long>>, kept_text string, kept_sha256 string")


def wording(unit: str) -> str:
    """A unit's key before it is digested; empty if it holds marks and blanks only."""
    return _BLANKS.sub(" ", unit.rstrip(_MARKS + _BLANK).lstrip(_BLANK)).lower()


def _digest(key: str) -> bytes:
    return hashlib.md5(key.encode("utf-8")).digest()


def paragraphs(text: str, min_run: int = MIN_RUN) -> Iterator[tuple[bytes | None, list[tuple[str, int, bytes | None]]]]:
    """Each paragraph: its digest (None if it has ``min_run`` code points of wording, or none), and its
    units, their lengths of wording, and their digests (None without wording)."""
    keys: list[str] = []
    units: list[tuple[str, int, bytes | None]] = []

    def done() -> tuple[bytes | None, list[tuple[str, int, bytes | None]]]:
        short = 0 < sum(map(len, keys)) < min_run
        return (_digest("\n" + "\n".join(keys)) if short else None), units  # no unit's key holds a line break

    for unit in UNIT.findall(text):
        key = wording(unit)
        units.append((unit, len(key), _digest(key) if key else None))
        if key:
            keys.append(key)
        if unit.count("\n") > 1:
            yield done()
            keys, units = [], []
    if units:
        yield done()


def unit_keys(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(key, _k): the distinct digests of each document's units and short paragraphs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            owners: list[int] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = set()
                for digest, units in paragraphs(text.as_py(), min_run):
                    own.add(digest)
                    own.update(d for _, _, d in units)
                own.discard(None)
                keys.extend(own)
                owners.extend([k] * len(own))
                if len(keys) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())],
                                                     names=["key", "_k"])
                    keys, owners = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())],
                                             names=["key", "_k"])
    return keyed_texts(docs).select("_k", "text").mapInArrow(run, KEYS)


def later_holders(keys: DataFrame) -> DataFrame:
    """(_k, drop): for each document the keys that a document with a smaller id holds too."""
    first = (keys.groupBy("key").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
             .where("_first < _last").select("key", "_first"))
    later = keys.join(first.hint("merge"), "key").where("_k > _first")
    return later.groupBy("_k").agg(F.collect_set("key").alias("drop"))


def judge(text: str, earlier: set[bytes], min_run: int = MIN_RUN) -> tuple[list[str], list[bool]]:
    """The units of a text, and which of them go, if smaller documents hold the digests in ``earlier``."""
    seen = set(earlier)
    units: list[str] = []
    gone: list[bool] = []
    run = length = 0  # where the open run of repeated units begins, and its wording

    def close() -> None:
        if length >= min_run:
            gone[run:] = [True] * (len(gone) - run)

    for digest, some in paragraphs(text, min_run):
        copied = digest in seen
        if digest:
            seen.add(digest)
        for unit, n, own in some:
            if own is not None and own not in seen:
                close()
                seen.add(own)
                run, length = len(units) + 1, 0
            length += n if own is not None and run <= len(units) else 0
            units.append(unit)
            gone.append(copied)
    close()
    return units, gone


def remove(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: what stays of it, and the removed spans (code points, end exclusive).

    ``n_removed`` counts removed units; neighbouring removed units make one span.
    """
    texts = keyed_texts(docs)
    path = scratch_path(docs.sparkSession, "unit-keys")
    unit_keys(docs, min_run).write.parquet(path)
    keys = docs.sparkSession.read.parquet(path)
    joined = texts.join(later_holders(keys), "_k", "left").select("doc_id", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()),
                 ("n_chars_removed", pa.int64()),
                 ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 ("kept_text", pa.string()), ("kept_sha256", pa.string())]
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = []
                some = batch.slice(part, 512)
                for doc_id, text, drop in zip(*(some.column(i).to_pylist() for i in range(3))):
                    units, gone = judge(text, set(drop or ()), min_run)
                    spans: list[dict] = []
                    at = 0
                    for unit, out in zip(units, gone):
                        if out and spans and spans[-1]["stop"] == at:
                            spans[-1]["stop"] = at + len(unit)
                        elif out:
                            spans.append({"start": at, "stop": at + len(unit)})
                        at += len(unit)
                    rest = "".join(u for u, out in zip(units, gone) if not out)
                    rows.append((doc_id, len(units), sum(gone), len(text) - len(rest), spans, rest,
                                 hashlib.sha256(rest.encode("utf-8")).hexdigest()))
                columns = list(zip(*rows)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)],
                                                 names=[name for name, _ in types])
    return joined.mapInArrow(run, REMOVED)
