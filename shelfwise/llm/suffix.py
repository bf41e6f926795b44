"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

A suffix array of a whole corpus cannot be sorted in one place, and most suffixes share no long
prefix with any other. So the suffixes are first dealt to buckets that keep equal strings
together, equal pieces of text are folded, and what is left is sorted bucket by bucket.

1. ``anchors``. Each ``SPAN``-byte window has an anchor: the ``GRAM``-byte string in it with the
   smallest hash (leftmost of equals). It depends on the window's bytes alone, so equal windows
   have equal anchors. The consecutive windows of one anchor form a piece (at most 81 windows),
   emitted as (hash of the anchor, hash of the piece, position). Pieces equal to an earlier one of
   the same chunk of texts are known repeats: they are dealt apart, not to their anchor's task.
2. ``settle``. Pieces are dealt by anchor and sorted by (anchor, piece, position). All windows of
   a piece that came before are repeats. The first of each wording stays open, but only if other
   wordings share its anchor; the rest is done.
3. ``fetch`` cuts the open pieces out of the texts. Where more than ``BUCKET`` wordings share an
   anchor (a hot passage between ever different neighbours), pieces are cut into single windows
   dealt by their own 128-bit hash instead, folded first in each task: equal strings still meet. Of
   these windows only the hash travels.
4. ``sort_blocks`` gathers whole buckets into blocks, leaves out what no window of another place can
   equal (by a rolling hash of the windows), builds a suffix array of the rest by two-stage sorting,
   and takes the runs of neighbours with 100 common bytes: in a run all but the earliest position are
   repeats. Of windows dealt by their hash all but the earliest of a hash are.
5. ``remove`` unites the repeated windows of each document and cuts the bytes they cover.

Two-stage sorting (``suffix_array``): only suffixes smaller than their successor are sorted
directly; a scan of the buckets in order of first symbol then induces all others, each placed by
the already placed suffix that follows it.

Positions are ordered by (doc_id, start). Texts travel once: the two joins of ``remove`` read the
same exchange.

Edge cases: a null text is empty; a text under 100 bytes has no window; a null doc_id ranks last;
rows that repeat a doc_id and text are one document, other rows that repeat a doc_id rank by a hash
of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import chunks, keyed_texts, mix64, powers, ranges, raw_strings

SPAN = 100
GRAM = 20
GRAMS = SPAN - GRAM + 1  # anchors a window chooses from
SEGMENT = 1 << 20  # window starts handled at a time
BLOCK_BYTES = 1 << 18
BUCKET = 4096  # wordings of one anchor that are sorted together

# A position within a document packs (20 bits of text hash, 36 bits of offset, 7 bits of windows).
_N_BITS, _OFFSET_BITS = 7, 36
_N_MASK, _OFFSET_MASK = (1 << _N_BITS) - 1, (1 << _OFFSET_BITS) - 1

def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number (zeros follow the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, piece hash, text number, first window and number of windows of each piece."""
    counts = np.maximum(np.diff(ends) - SPAN + 1, 0)
    forward, back = powers(min(len(data), SEGMENT + SPAN) + 1)
    for low in range(0, max(len(data) - SPAN + 1, 0), SEGMENT):
        part = data[low:low + SEGMENT + SPAN - 1]
        word = _words(part)
        n = len(part) - GRAM + 1
        gram = mix64(word[:n] * np.uint64(0xFF51AFD7ED558CCD) + word[8:8 + n] * np.uint64(0xC4CEB9FE1A85EC53)
                     + word[GRAM - 8:GRAM - 8 + n] * np.uint64(0xD6E8FEB86659FD93))
        least = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:len(least) - (GRAMS - width)], least[GRAMS - width:])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        # Window starts of this segment that lie wholly in their text.
        first = np.maximum(ends[:-1], low)
        number = np.minimum(ends[:-1] + counts, low + min(SEGMENT, len(at))) - first
        number = np.maximum(number, 0)
        starts = ranges(first, number) - low
        if not len(starts):
            continue
        anchor = at[starts]
        new = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
        a, windows = starts[new], np.diff(new, append=len(starts))
        stop = a + windows + SPAN - 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(0x51)) * forward[:len(part)], out=total[1:])
        piece = (total[stop] - total[a]) * back[a]
        piece = mix64(piece + (windows * 128 + anchor[new] - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        owner = np.searchsorted(ends, a + low, side="right") - 1
        yield gram[anchor[new]], piece, owner, a + low - ends[owner], windows


def _pack(version, offset, windows):
    return (version << (_N_BITS + _OFFSET_BITS)) | (offset << _N_BITS) | windows


def _earliest(one: np.ndarray, two: np.ndarray, k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows, sorted by all four, are the first of their hashes, and which lie elsewhere than that one."""
    new = np.r_[True, (np.diff(one) != 0) | (np.diff(two) != 0)][:len(one)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
    return new, (k != k[start]) | (at != at[start])


def _folded(h: np.ndarray, c: np.ndarray, k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces, those with an earlier equal one among them marked by ``~at``; these are dealt by document
    and segment, not by anchor."""
    both = h * np.int64(-0x61C8864680B583EB) ^ c
    by = np.argsort(both)
    same = np.diff(both[by]) == 0
    some = np.flatnonzero(np.r_[False, same][:len(by)] | np.r_[same, False][:len(by)])
    by = by[some]
    by = by[np.lexsort((at[by], k[by], c[by], h[by]))]
    _, again = _earliest(h[by], c[by], k[by], at[by])
    again = by[again]
    h[again] = mix64((k[again] * np.int64(0x9E3779B9) + (at[again] >> (_N_BITS + 20))).view(np.uint64)).view(np.int64)
    c[again], at[again] = 0, ~at[again]
    return h, c, k, at


def anchors(texts: DataFrame) -> DataFrame:
    """(h, c, _k, at): the pieces of (_k, _v, text) rows, folded in each chunk of texts (``_folded``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            for rows, data, ends in chunks(batch):
                for h, c, owner, offset, windows in _pieces(data, ends):
                    at = _pack(v[rows][owner], offset, windows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in _folded(h.view(np.int64), c.view(np.int64), k[rows][owner], at)],
                        names=["h", "c", "_k", "at"])
    return texts.select("_k", "_v", "text").mapInArrow(run, "h long, c long, _k long, at long")


def settle(pieces: DataFrame) -> DataFrame:
    """(_k, at, kind, h): kind 0, repeated pieces; 1, open ones; 2, open ones of a hot anchor."""
    def emit(k, at, kind, h):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(k, np.int64)), pa.array(np.asarray(at, np.int64)),
             pa.array(np.broadcast_to(np.int32(kind), len(k)).astype(np.int32)), pa.array(np.asarray(h, np.int64))],
            names=["_k", "at", "kind", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (h, c, _k, at) of the first row of the current wording
        # Of the anchor that may go on in the next batch: first rows of its wordings, until it is hot.
        open_h, held_k, held_at, hot = None, np.zeros(0, np.int64), np.zeros(0, np.int64), False

        def closed():
            if len(held_k) > 1 and not hot:
                yield emit(held_k, held_at, 1, np.full(len(held_k), open_h))

        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, k, at = (np.asarray(batch.column(i), np.int64) for i in range(4))
            past = at < 0
            yield emit(k[past], ~at[past], 0, h[past])
            h, c, k, at = (x[~past] for x in (h, c, k, at))
            if not len(h):
                continue
            if last is not None:
                h, c, k, at = (np.concatenate([[x], y]) for x, y in zip(last, (h, c, k, at)))
            new = np.empty(len(h), bool)
            new[0] = last is None
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = (k != k[start]) | (at != at[start])
            yield emit(k[again], at[again], 0, h[again])
            i = start[-1]
            last = (h[i], c[i], k[i], at[i])
            w = np.flatnonzero(new)
            if not len(w):
                continue
            cuts = np.flatnonzero(np.r_[True, np.diff(h[w]) != 0])
            sizes = np.diff(np.r_[cuts, len(w)])
            if h[w[0]] == open_h:  # the open anchor goes on
                held_k, held_at = np.r_[held_k, k[w[:sizes[0]]]], np.r_[held_at, at[w[:sizes[0]]]]
                if hot or len(held_k) > BUCKET:
                    yield emit(held_k, held_at, 2, np.full(len(held_k), open_h))
                    hot, held_k, held_at = True, held_k[:0], held_at[:0]
                cuts, sizes = cuts[1:], sizes[1:]
            if not len(cuts):
                continue
            yield from closed()
            whole = np.repeat(sizes, sizes)[:len(w) - cuts[0] - sizes[-1]]
            mine = w[cuts[0]:len(w) - sizes[-1]]
            for kind, pick in ((1, (whole > 1) & (whole <= BUCKET)), (2, whole > BUCKET)):
                yield emit(k[mine[pick]], at[mine[pick]], kind, h[mine[pick]])
            tail = w[cuts[-1]:]
            open_h, held_k, held_at, hot = h[tail[0]], k[tail], at[tail], False
            if len(held_k) > BUCKET:
                yield emit(held_k, held_at, 2, np.full(len(held_k), open_h))
                hot, held_k, held_at = True, held_k[:0], held_at[:0]
        yield from closed()

    return (pieces.repartition("h").sortWithinPartitions("h", "c", "_k", "at").select("h", "c", "_k", "at")
            .mapInArrow(run, "_k long, at long, kind int, h long"))


def _window_hashes(data: np.ndarray, starts: np.ndarray, *codes: np.ndarray) -> Iterator[np.ndarray]:
    """A 64-bit hash of each ``SPAN``-byte window that begins at ``starts``, per code of the 256 bytes."""
    forward, back = powers(len(data) + 1)
    for code in codes:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(code[data] * forward[:len(data)], out=total[1:])
        yield mix64((total[starts + SPAN] - total[starts]) * back[starts])


_CODES = mix64(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)


def _runs(k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(_k, at) of single windows as runs of at most ``SPAN`` neighbours."""
    by = np.lexsort((at, k))
    k, place = k[by], at[by] >> _N_BITS
    new = np.r_[True, (np.diff(k) != 0) | (np.diff(place) > 1)][:len(k)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    new |= (place - place[first]) % SPAN == 0
    new[1:] &= (np.diff(place) != 0) | (np.diff(k) != 0)
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(k)] - 1
    return k[begin], place[begin] << _N_BITS | (place[last[:len(begin)]] - place[begin] + 1)


def single_windows(k: np.ndarray, at: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """The windows of pieces, folded: two hashes, _k and ``at`` of the earliest of each, and (_k, at) of the others."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(lengths) - lengths
    windows = lengths - SPAN + 1
    starts = ranges(first, windows)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    one, two = (x.view(np.int64) for x in _window_hashes(data, starts, *_CODES))
    k, at = np.repeat(k, windows), _pack(0, np.repeat(at >> _N_BITS, windows) + starts - np.repeat(first, windows), 1)
    by = np.lexsort((at, k, two, one))
    one, two, k, at = one[by], two[by], k[by], at[by]
    new, again = _earliest(one, two, k, at)
    return one[new], two[new], k[new], at[new], k[again], at[again]


def fetch(texts: DataFrame, settled: DataFrame) -> DataFrame:
    """(h, _k, at, piece): the open pieces with their bytes, or single windows with 8 bytes of their hash; a null
    piece is a repeat found here."""
    schema = pa.schema([("h", pa.int64()), ("_k", pa.int64()), ("at", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def singles(held: list[tuple]) -> pa.RecordBatch:
            one, two, k, at, again_k, again_at = single_windows(
                *(np.array([x[i] for x in held], np.int64) for i in (0, 1)), [x[2] for x in held])
            again_k, again_at = _runs(again_k, again_at)
            # The second hash as 8 bytes; nulls for the repeats.
            piece = pa.Array.from_buffers(pa.binary(8), len(two), [None, pa.py_buffer(np.ascontiguousarray(two))])
            piece = pa.concat_arrays([piece.cast(pa.binary()), pa.nulls(len(again_k), pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array(np.r_[one, again_k]), pa.array(np.r_[k, again_k]),
                                               pa.array(np.r_[at, again_at]), piece], schema=schema)

        for batch in batches:
            hot: list[tuple] = []  # pieces of hot anchors, about a segment of bytes at a time
            size = 0
            rows: list[tuple] = []
            for k, text, open_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_buffer()
                for x in open_:
                    offset, n = x["at"] >> _N_BITS & _OFFSET_MASK, x["at"] & _N_MASK
                    piece = data.slice(offset, n + SPAN - 1).to_pybytes()
                    if x["kind"] == 1:
                        rows.append((x["h"], k, x["at"], piece))
                        continue
                    hot.append((k, x["at"], piece))
                    size += len(piece)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
                if size >= SEGMENT:
                    yield singles(hot)
                    hot, size = [], 0
            if hot:
                yield singles(hot)
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
    # The columns that are not used here keep both sides equal to those that ``remove`` joins, so
    # that Spark reads the same exchanges again.
    joined = settled.where("size(open) > 0").join(texts, ["_k", "_v"]).select("_k", "text", "open", "again", "doc_id")
    return joined.mapInArrow(run, "h long, _k long, at long, piece binary")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Two-stage suffix sorting of strings that each end in a 0 (other symbols are 1 to 256).

    Suffixes compare within their own string, to a depth of at least ``SPAN`` symbols; equal ones
    stand together. A suffix is *small* if it is less than its successor; ends count as small.
    """
    n = len(symbols)
    change = np.flatnonzero(np.diff(symbols) != 0)
    run_end = np.full(n, n - 1)
    at = np.searchsorted(change, np.arange(n), side="left")
    inside = at < len(change)
    run_end[inside] = change[at[inside]]
    follows = np.zeros(n, symbols.dtype)
    follows[inside] = symbols[run_end[inside] + 1]
    small = (symbols < follows) | (symbols == 0)

    # Stage one: sort the small suffixes directly, by their symbols up to the end of their string.
    chosen = np.flatnonzero(small)
    ends = np.flatnonzero(symbols == 0)
    depth = SPAN + 4
    padded = np.zeros(n + depth, np.uint8)
    padded[:n] = np.maximum(symbols, 1) - 1
    left = ends[np.searchsorted(ends, chosen)] - chosen
    keys = padded[chosen[:, None] + np.arange(depth)]
    keys[np.arange(depth) >= left[:, None]] = 0
    order = np.lexsort((np.ascontiguousarray(keys).view(f"S{depth}").ravel(), symbols[chosen]))
    chosen = chosen[order]
    cut = np.searchsorted(symbols[chosen], np.arange(258))

    # Stage two: scan the buckets; each suffix placed puts the one before it, if that is not small,
    # at the next place of that one's bucket.
    queues: list[list[np.ndarray]] = [[] for _ in range(257)]
    placed: list[np.ndarray] = []

    def induce(found: np.ndarray, symbol: int) -> np.ndarray:
        """Queues the large predecessors of ``found``; returns those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        heads = symbols[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.diff(heads, prepend=-1))
        same = before[:0]
        for group, head in zip(np.split(before, cuts[1:]), heads[cuts] if len(cuts) else ()):
            if head == symbol:
                same = group
            else:
                queues[head].append(group)
        return same

    for symbol in range(257):
        wave = np.concatenate(queues[symbol]) if queues[symbol] else chosen[:0]
        while len(wave):
            placed.append(wave)
            wave = induce(wave, symbol)
        own = chosen[cut[symbol]:cut[symbol + 1]]
        placed.append(own)
        induce(own, symbol)
    return np.concatenate(placed)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it, counted up to ``SPAN`` bytes."""
    found = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 1 << 15):
        some = order[low:low + (1 << 15)]
        own = data[some[:, None] + np.arange(SPAN)]
        other = data[order[low - 1:low - 1 + len(some)][:, None] + np.arange(SPAN)]
        differ = own != other
        found[low:low + len(some)] = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
    return found


def _alike(k: np.ndarray, at: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The pieces cut to their windows, first to last, whose hash another window of the block has too.

    Equal windows have equal hashes, so no repeat is lost; windows of equal hashes need not be equal."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(lengths) - lengths
    windows = lengths - SPAN + 1
    starts = ranges(first, windows)
    (value,) = _window_hashes(np.frombuffer(b"".join(pieces), np.uint8), starts, _CODES[0])
    by = np.argsort(value)
    same = np.diff(value[by]) == 0
    some = np.zeros(len(value), bool)
    some[by[1:][same]] = some[by[:-1][same]] = True
    found = np.flatnonzero(some)
    owner = np.repeat(np.arange(len(pieces)), windows)[found]
    new = np.r_[True, np.diff(owner) != 0][:len(owner)]
    low, owner = (starts[found] - first[owner])[new], owner[new]
    stop = (starts[found[np.r_[np.flatnonzero(new)[1:], len(found)][:len(owner)] - 1]] - first[owner]) + SPAN
    return (k[owner], at[owner] + (low << _N_BITS),
            [pieces[i][a:b] for i, a, b in zip(owner.tolist(), low.tolist(), stop.tolist())])


def repeated_windows(k: np.ndarray, at: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(_k, at) of the runs of windows of a block of pieces that also start earlier in the block."""
    k, at, pieces = _alike(k, at, pieces)
    if not pieces:
        return k, at
    lengths = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 1
    symbols[first + lengths] = 0
    windows = lengths - SPAN + 1
    starts = ranges(first, windows)
    owner = np.full(len(data), -1, np.int64)
    owner[starts] = np.repeat(np.arange(len(pieces)), windows)
    order = suffix_array(symbols)
    order = order[owner[order] >= 0]  # only these have SPAN bytes of their own
    same = common_prefixes(data, order) >= SPAN
    piece = owner[order]
    place = (at[piece] >> _N_BITS) + (order - first[piece])
    rank = np.empty(len(order), np.int64)
    by = np.lexsort((place, k[piece]))
    step = np.r_[False, (np.diff(place[by]) != 0) | (np.diff(k[piece][by]) != 0)]
    rank[by] = np.cumsum(step)
    heads = np.flatnonzero(~same)
    earliest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(order)])) if len(heads) else rank
    gone = np.zeros(len(data) + 1, bool)
    gone[order[rank > earliest]] = True
    edge = np.diff(np.r_[False, gone].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = owner[begin]
    return k[piece], ((at[piece] >> _N_BITS) + begin - first[piece]) << _N_BITS | (end - begin)


def sort_blocks(fetched: DataFrame) -> DataFrame:
    """(_k, at): the repeated windows among the open pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k, at):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64), pa.int64()) for x in (k, at)],
                                              names=["_k", "at"])
        held: list[tuple] = []
        size = 0
        last = None  # the earliest window of the hash that may go on in the next batch
        for batch in batches:
            width = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
            none = width == 0
            yield found(*(batch.column(i).to_numpy()[none] for i in (1, 2)))
            single = batch.filter(pa.array(width == 8))
            if single.num_rows:
                one, k, at = (single.column(i).to_numpy() for i in range(3))
                two = np.frombuffer(b"".join(single.column(3).to_pylist()), np.int64)
                if last is not None:
                    one, two, k, at = (np.concatenate([[x], y]) for x, y in zip(last, (one, two, k, at)))
                new, again = _earliest(one, two, k, at)
                i = np.flatnonzero(new)[-1]
                last = (one[i], two[i], k[i], at[i])
                yield found(*_runs(k[again], at[again]))
            for row in zip(*(x.to_pylist() for x in batch.filter(pa.array(width >= SPAN)).columns)):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield found(*repeated_windows(*(np.array([x[i] for x in held], np.int64) for i in (1, 2)),
                                                  [x[3] for x in held]))
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found(*repeated_windows(*(np.array([x[i] for x in held], np.int64) for i in (1, 2)),
                                          [x[3] for x in held]))
    return (fetched.repartition("h").sortWithinPartitions("h", "piece", "_k", "at").select("h", "_k", "at", "piece")
            .mapInArrow(run, "_k long, at long"))


def spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of bytes that some of the packed windows cover."""
    start = np.sort(at >> _N_BITS & _OFFSET_MASK)
    stop = (at >> _N_BITS & _OFFSET_MASK) + (at & _N_MASK) + SPAN - 1
    stop = np.maximum.accumulate(stop[np.argsort(at >> _N_BITS & _OFFSET_MASK, kind="stable")])
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new], stop[np.r_[np.flatnonzero(new)[1:] - 1, len(stop) - 1]]


_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                      ("n_spans", pa.int64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                      ("kept", pa.binary()), ("kept_sha256", pa.string())])


def remove(docs: DataFrame) -> DataFrame:
    """One row per document: its length, the removed spans (bytes), and what stays."""
    texts = keyed_texts(docs).withColumn(
        "_v", F.xxhash64("text").bitwiseAND(F.lit((1 << 20) - 1)))
    texts = texts.select("_k", "_v", "doc_id", "text")
    version = F.shiftright("at", _N_BITS + _OFFSET_BITS).alias("_v")
    settled = (settle(anchors(texts)).groupBy("_k", version)
               .agg(F.collect_list(F.when(F.col("kind") == 0, F.col("at"))).alias("again"),
                    F.collect_list(F.when(F.col("kind") > 0, F.struct("h", "at", "kind"))).alias("open")))
    sorted_ = sort_blocks(fetch(texts, settled)).groupBy("_k", version).agg(F.collect_list("at").alias("more"))
    joined = (texts.join(settled, ["_k", "_v"], "left").join(sorted_, ["_k", "_v"], "left")
              .select("doc_id", "text", "again", "more", "open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some, rows = batch.slice(low, 512), []
                data, ends = raw_strings(some.column(1))
                for i, (doc_id, again, more) in enumerate(zip(*(some.column(c) for c in (0, 2, 3)))):
                    text = data[ends[i]:ends[i + 1]]
                    at = np.concatenate([x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)
                                         for x in (again, more)])
                    cut, kept = [], text
                    if len(at):
                        start, stop = spans(at)
                        mark = np.zeros(len(text) + 1, np.int32)
                        np.add.at(mark, start, 1)
                        np.add.at(mark, stop, -1)
                        keep = np.cumsum(mark)[:-1] == 0
                        kept = text[keep]
                        cut = [{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist())]
                    left = kept.tobytes()
                    rows.append((doc_id.as_py(), len(text), len(text) - len(left), len(cut), cut, left,
                                 hashlib.sha256(left).hexdigest()))
                columns = list(zip(*rows)) or [()] * len(_REMOVED)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _REMOVED.types)], schema=_REMOVED)
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                  "spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string")
