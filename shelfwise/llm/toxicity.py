"""Toxicity scores: a Levenshtein automaton over a lexicon trie, with context windows.

Lexicon. ``learn`` draws a bounded sample of labelled texts (``MAX_TOXIC`` toxic and ``MAX_CLEAN``
other ones at most, by a hash of doc_id) and looks for words and word stems (first letters of at
least ``MIN_STEM``) that toxic texts have and others do not. An entry is a whole word, if one
word accounts for nearly all texts with its stem, or a stem with any ending. Entries are chosen
greedily by the toxic texts they newly explain, so words that merely stand beside toxic ones in
copied texts are left out.

Matching. The trie of the lexicon is intersected with the Levenshtein automaton (substitution,
insertion, deletion, swap of two neighbours) of distance one for entries of ``MIN_FUZZY`` letters or
more and two from ``MIN_TWO`` on; shorter ones (three letters) match exactly. A stem matches a word
that begins within its distance of it. Digits that stand for letters (``LEET``) match those letters
in a word that has letters too; such a match counts as misspelled. The intersection is determinised
state by state as words need it, and all words of a block of texts walk through it together, letter
by letter; most die after a few letters. The states that the sample needed travel with the lexicon.
Misspellings that clean texts of the sample use are ordinary words and never count; what an entry's
other misspellings weigh is limited by how many of them one half of the clean texts has that the
other half has not, so a short stem that resembles many words gains little by them.

Context. A hit is *quoted* if, in a window of ``WINDOW`` words, a quotation mark opens before it
and one closes after it, else *abuse*; quoted and other hits are weighed apart. The score is a
logistic function of the weightiest hit, of the number of hits, and of the quoted share, fitted to
the sample (a clean text's hits as if its own half's misspellings were unknown) with a prior by which a quoted or misspelled hit counts less than a plain one.

Each entry is held by a share of a bounded sample, so the lexicon is bounded too and goes to the tasks
with the function; scoring is one pass over all whole texts without a shuffle.

Edge cases: a null or empty text scores like a text without hits; without toxic or without other
labelled texts the lexicon is empty and every text scores 0; rows that repeat a doc_id are scored
on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOXIC, MAX_CLEAN = 1500, 3000
MIN_STEM, MIN_FUZZY, MIN_TWO = 4, 4, 8
MIN_SUPPORT, MIN_LIFT = 0.004, 20.0
WINDOW = 6
END = "\0"  # marks a whole word among stems
CHUNK_CHARS = 1 << 20
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}

_WORD = re.compile(r"[^\W_]+")
# Word characters (letters and digits) below 0x10000; all above count as letters.
_IS_WORD = np.array([chr(c).isalnum() for c in range(0x10000)])
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"


class Automaton:
    """The lexicon's trie with the Levenshtein automaton of each entry's distance, determinised as needed.

    A state is a set of (entry, letters matched, errors, whether the second of two swapped letters has
    come); ``step`` has transitions by (state, letter class), -1 where not yet known; state 0 is dead.
    ``entry`` and ``distance`` are those of the lexicon entry a word matches if it ends in the state
    (-1: none); in a ``sure`` state it has matched whatever follows.
    """

    def __init__(self, entries: list[str]) -> None:
        self.stems = [not e.endswith(END) for e in entries]
        self.terms = [e.rstrip(END) for e in entries]
        self.most = [(len(t) >= MIN_FUZZY) + (len(t) >= MIN_TWO) for t in self.terms]
        self.alphabet = ["", *sorted({c for t in self.terms for c in t} | set(LEET))]  # "": any other letter
        self.letters = np.zeros(0x10000, np.int64)
        for i, c in enumerate(self.alphabet):
            if c and ord(c) < 0x10000:
                self.letters[ord(c)] = i
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.step = np.full((1024, len(self.alphabet)), -1, np.int32)
        self.entry, self.distance = np.full(1024, -1, np.int32), np.zeros(1024, np.int32)
        self.sure = np.zeros(1024, bool)
        self._add(frozenset())
        self.step[0] = 0
        self._add(self._least({(e, 0, 0, 0) for e in range(len(entries))}))

    def _add(self, state: frozenset) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            if at == len(self.entry):
                self.step = np.vstack([self.step, np.full_like(self.step, -1)])
                self.entry = np.r_[self.entry, np.full_like(self.entry, -1)]
                self.distance, self.sure = np.r_[self.distance, self.distance * 0], np.r_[self.sure, self.sure & False]
            done = [(d + len(self.terms[e]) - i, e) for e, i, d, swap in state
                    if not swap and d + len(self.terms[e]) - i <= self.most[e]]
            if done:
                self.distance[at], self.entry[at] = min(done)
                self.sure[at] = all(self.stems[e] and i == len(self.terms[e]) for e, i, _, _ in state)
        return at

    def _least(self, found: set) -> frozenset:
        """Without what cannot lead to a smaller distance than the rest."""
        matched = [(d + len(self.terms[e]) - i, e) for e, i, d, swap in found
                   if self.stems[e] and not swap and d + len(self.terms[e]) - i <= self.most[e]]
        if matched:  # the word's beginning matches a stem: only fewer errors are of interest
            d, e = min(matched)
            found = {x for x in found if x[2] < d} | {(e, len(self.terms[e]), d, 0)}
        best: dict[int, list] = {}
        for e, i, d, swap in sorted(found, key=lambda x: x[2]):
            some = best.setdefault(e, [])
            if swap or not any(not s and abs(i - j) <= d - n for j, n, s in some):
                some.append((i, d, swap))
        return frozenset((e, *x) for e, some in best.items() for x in some)

    def _move(self, state: frozenset, c: str) -> frozenset:
        after = set()
        like = LEET.get(c, "")
        for e, i, d, swap in state:
            term, most = self.terms[e], self.most[e]
            if swap:
                if term[i] == c:
                    after.add((e, i + 2, d, 0))
                continue
            if self.stems[e] and i == len(term):
                after.add((e, i, d, 0))
                continue
            for skip in range(most - d + 1):  # letters of the entry left out
                at, n = i + skip, d + skip
                if at < len(term) and c and (term[at] == c or term[at] in like):
                    after.add((e, at + 1, n, 0))
            if d < most:
                after.add((e, i, d + 1, 0))
                if i < len(term):
                    after.add((e, i + 1, d + 1, 0))
                for skip in range(most - d):
                    at = i + skip
                    if at + 1 < len(term) and c and term[at + 1] == c != term[at]:
                        after.add((e, at, d + skip + 1, 1))
        return self._least(after)

    def walk(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states after one letter each."""
        after = self.step[states, classes]
        unknown = after < 0
        if unknown.any():
            pairs = np.unique(states[unknown].astype(np.int64) * len(self.alphabet) + classes[unknown])
            for pair in pairs.tolist():
                state, c = divmod(pair, len(self.alphabet))
                reached = self._add(self._move(self.states[state], self.alphabet[c]))
                self.step[state, c] = reached
            after = self.step[states, classes]
        return after


def matches(auto: Automaton, codes: np.ndarray, starts: np.ndarray,
            stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words that match, their entries and distances; all words walk in step."""
    state = np.ones(len(starts), np.int32)
    ended = np.zeros(len(starts), np.int32)
    live, depth = np.arange(len(starts)), 0
    while len(live):
        code = codes[starts[live] + depth]
        state[live] = auto.walk(state[live], np.where(code < 0x10000, auto.letters[np.minimum(code, 0xFFFF)], 0))
        depth += 1
        done = (starts[live] + depth == stops[live]) | auto.sure[state[live]]
        ended[live[done]] = state[live[done]]
        live = live[~done & (state[live] > 0)]
    hit = np.flatnonzero(auto.entry[ended] >= 0)
    return hit, auto.entry[ended[hit]], auto.distance[ended[hit]]


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.r_[False, np.where(codes < 0x10000, _IS_WORD[np.minimum(codes, 0xFFFF)], True), False]
    edge = np.diff(inside.astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def is_quoted(text: str, starts: np.ndarray, stops: np.ndarray, word: int) -> bool:
    """Whether quotation marks enclose the word within its window, nearest marks counting."""
    low, high = starts[max(0, word - WINDOW)], stops[min(len(stops) - 1, word + WINDOW)]
    before, after = text[low - 1 if low else 0:starts[word]], text[stops[word]:high + 1]
    opened = any(c in _OPEN for c in before) and before.count('"') % 2 == ('"' in before)
    return opened and any(c in _CLOSE for c in after)


@dataclass
class Lexicon:
    entries: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # by entry and distance
    ordinary: frozenset[str] = frozenset()
    model: np.ndarray | None = None
    auto: Automaton | None = None

    def hits(self, texts: list[str]) -> Iterator[tuple[int, str, int, int, bool]]:
        """Text number, word, entry, distance and whether quoted, of each hit."""
        if self.auto is None:
            return
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts, stops = word_bounds(codes)
        found, entry, distance = matches(self.auto, codes, starts, stops)
        owner = np.searchsorted(ends, starts[found], side="right")
        for w, e, d, o in zip(found.tolist(), entry.tolist(), distance.tolist(), owner.tolist()):
            word = joined[starts[w]:stops[w]]
            if d == 0 and not word.startswith(self.auto.terms[e]):
                d = 1  # digits for letters
            if d and (word in self.ordinary or word.isdigit()):
                continue
            first, last = (0 if o == 0 else ends[o - 1]), ends[o] - 1
            a, b = np.searchsorted(starts, first), np.searchsorted(starts, last)
            quoted = is_quoted(texts[o], starts[a:b] - first, stops[a:b] - first, w - a) if self._marks(texts[o]) else False
            yield o, word, e, d, quoted

    @staticmethod
    def _marks(text: str) -> bool:
        return any(c in text for c in _OPEN)

    def describe(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of each text (weightiest plain and quoted hit, hits, quoted share) and its hits."""
        x, n, quoted = np.zeros((len(texts), 4)), np.zeros(len(texts)), np.zeros(len(texts))
        for o, _, e, d, q in self.hits(texts):
            weight = self.weights[e, d]
            x[o, int(q)] = max(x[o, int(q)], weight)
            n[o] += weight > 0
            quoted[o] += q and weight > 0
        x[:, 2], x[:, 3] = np.log1p(n), quoted / np.maximum(n, 1)
        return x, n.astype(np.int64)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.model is None:
            return np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        x, n = self.describe(texts)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.model[1:] + self.model[0], -30, 30))), n


def _choose(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Stems and whole words that explain the toxic texts; each text is the set of its words."""
    def stems(words: set[str]) -> set[str]:
        return {s for w in words for s in [*(w[:i] for i in range(MIN_STEM, len(w) + 1)), w + END] if len(s) >= MIN_STEM}
    bad = [stems(t) for t in toxic]
    support = Counter(s for t in bad for s in t)
    least = max(3, MIN_SUPPORT * len(toxic))
    known = {s for s, n in support.items() if n >= least}
    usual = Counter(s for t in clean for s in stems(t) & known)
    lift = {s: support[s] / len(toxic) / ((usual[s] + 0.5) / len(clean)) for s in known}
    good = {s for s in known if lift[s] >= MIN_LIFT}
    # A stem grows while one longer form has nearly all its toxic texts, or most of them and far fewer others.
    longer = defaultdict(list)
    for s in good:
        longer[s[:-1]].append(s)

    def grown(s: str) -> str:
        while True:
            best = max(longer[s], key=lambda x: (support[x], x), default=None)
            share = support[best] / support[s] if best else 0.0
            if share < 0.6 or share < 0.95 and usual[best] + 0.5 > 0.25 * (usual[s] + 0.5):
                return s
            s = best
    roots = {grown(s) for s in good if s[:-1] not in good}
    holders = defaultdict(set)
    for i, t in enumerate(bad):
        for s in t & roots:
            holders[s].add(i)
    chosen: list[str] = []
    open_ = set(range(len(toxic)))
    pool = dict(holders)
    while pool:
        best = max(pool, key=lambda s: (len(pool[s] & open_), len(pool[s]), s))
        # What newly explains few texts may still be an entry, if it is as frequent as the others.
        if len(pool[best] & open_) < least:
            break
        chosen.append(best)
        open_ -= pool.pop(best)
    typical = np.median([len(holders[s]) for s in chosen]) if chosen else 0
    return chosen + [s for s in sorted(pool) if len(holders[s]) >= max(least, 0.3 * typical) and usual[s] == 0]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps towards a prior; both labels weigh alike."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array([-3.0, 1.0, 0.4, 0.5, -0.5])
    strength = np.array([0.01, 1.0, 4.0, 1.0, 4.0])
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = prior.copy()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + strength * (w - prior)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(strength)
        move = np.linalg.solve(curve, gradient)
        w = w - np.clip(move, -1.0, 1.0)
        if np.abs(move).max() < 1e-6:
            break
    return w


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """Learns lexicon and weights from a bounded sample of ``labels`` (doc_id, toxic)."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Lexicon()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = marked.where(draw < F.when(F.col("toxic") == 1, max_toxic / counts[1]).otherwise(max_clean / counts[0]))
    drawn = F.broadcast(drawn.limit(2 * (max_toxic + max_clean)))  # bounded by the limit
    got = (_texts(docs).join(drawn, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
           .limit(2 * (max_toxic + max_clean)).toArrow())
    rows = sorted(zip(got.column("toxic").to_pylist(), got.column("text").to_pylist()))
    toxic, clean = ([t for y, t in rows if y == want] for want in (1, 0))
    if not toxic or not clean:
        return Lexicon()
    words = [[set(_WORD.findall(t)) for t in some] for some in (toxic, clean)]
    entries = _choose(*words)
    if not entries:
        return Lexicon()
    lexicon = Lexicon(entries, np.zeros((len(entries), 3)), frozenset(), None, Automaton(entries))
    seen = [defaultdict(set), defaultdict(set)]
    misspelled: list[tuple[int, str, int, int]] = []  # in clean texts
    halves: tuple[set[str], set[str]] = (set(), set())
    for label, some in ((1, toxic), (0, clean)):
        for low in range(0, len(some), 64):
            for o, word, e, d, _ in lexicon.hits(some[low:low + 64]):
                seen[label][e, d].add(low + o)
                if label == 0 and d:
                    misspelled.append((low + o, word, e, d))
                    halves[(low + o) % 2].add(word)
    lexicon.ordinary = frozenset(halves[0] | halves[1])
    unforeseen = defaultdict(set)
    for text, word, e, d in misspelled:
        if word not in halves[1 - text % 2]:
            unforeseen[e, d].add(text)
    for e in range(len(entries)):
        rate = (len(seen[1][e, 0]) + 0.5) / len(toxic)
        plain = np.log(rate / ((len(seen[0][e, 0]) + 0.5) / len(clean)))
        most = [np.log(rate / ((len(unforeseen[e, d]) + 0.5) / len(clean))) for d in (1, 2)]
        lexicon.weights[e] = max(plain, 0.0), max(min(0.8 * plain, most[0]), 0.0), max(min(0.64 * plain, most[1]), 0.0)
    # Clean texts are described as unseen ones would be: by the ordinary words of the other half.
    known, x = lexicon.ordinary, []
    for some, words_known in ((toxic, known), (clean[::2], frozenset(halves[1])), (clean[1::2], frozenset(halves[0]))):
        lexicon.ordinary = words_known
        x += [lexicon.describe(some[low:low + 64])[0] for low in range(0, len(some), 64)]
    lexicon.ordinary = known
    lexicon.model = _fit(np.vstack(x), np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    return lexicon


def predict(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, n_hits) for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(ids, texts):
            score, n = lexicon.score(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score), pa.array(n)],
                                              names=["doc_id", "score", "n_hits"])
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= CHUNK_CHARS or len(texts) >= 4096:
                    yield scored(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield scored(ids, texts)
    return _texts(docs).mapInArrow(run, "doc_id long, score double, n_hits long")
