"""Language identification by hierarchical discrimination.

A first set of linear support vector machines, one family against the rest, predicts the language
family; then one machine for each pair of the family's languages votes between the two, and the
language with most votes wins (at equal votes the larger sum of margins). Features are hashed
byte 1- to 4-grams of the lower-cased text with every run of non-letters as one blank, as square
roots of relative frequencies, so a text's vector has length one.

Training reads a bounded sample: ``MAX_TRAIN`` labelled texts at most, the same number of each
language, drawn by a hash of doc_id. Only texts with a letter and a non-null label count. The
machines are fitted in one task, which holds the sample (16 KB a text), so only their weights
(``BUCKETS`` per family and pair) come to the driver and go to the tasks with the function; prediction
is one pass over all texts without a shuffle.

``score`` is the product of the winning family's softmax share and, within it, the winning
language's share, at margins times ``SHARPNESS``; it says how clearly both won. The language's
share couples its pairs: 1 / (1 + the sum of its odds against), which for two languages is the softmax.

Edge cases: a null text or one without a letter is ``und`` with score 0; if no labelled text is
there to learn from, every text is ``und``; with one language to learn every other text gets it
with score 1; ties go to the first family or language by code point; rows that repeat a doc_id are
predicted on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import chunks

# Families of language codes. A code that is not here is a family of its own.
FAMILIES: dict[str, str] = {
    **dict.fromkeys(["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"], "germanic"),
    **dict.fromkeys(["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"], "romance"),
    **dict.fromkeys(["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"], "slavic"),
    **dict.fromkeys(["lt", "lv"], "baltic"),
    **dict.fromkeys(["et", "fi", "hu"], "uralic"),
    **dict.fromkeys(["az", "kk", "tr", "uz"], "turkic"),
    **dict.fromkeys(["bn", "fa", "gu", "hi", "mr", "ne", "pa", "ur"], "indo-iranian"),
}

UNKNOWN = "und"
BUCKETS = 4096
GRAMS = (1, 2, 3, 4)
MAX_TRAIN = 2000
RIDGE, STEPS = 1e-4, 150
SHARPNESS = 6.0
MIN_SCORE = 0.3  # under it ``accepted`` rejects a text: hardly better than chance among four languages

# Bytes to letters: ASCII letters to lower case, other ASCII to blank, bytes of other characters as they are.
_LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row per text of square roots of the relative frequencies of hashed byte n-grams."""
    n = len(ends) - 1
    letters = _LETTER[data]
    owner = np.repeat(np.arange(n), np.diff(ends))
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (owner[1:] != owner[:-1])
    letters, owner = letters[keep].astype(np.uint32), owner[keep].astype(np.int64)
    total = np.zeros(n * BUCKETS)
    packed = np.zeros(len(letters), np.uint32)
    for size in range(1, max(GRAMS) + 1):
        m = len(letters) - size + 1
        if m <= 0:
            break
        packed = (packed[:m] << np.uint32(8)) | letters[size - 1:]
        own = owner[:m] == owner[size - 1:]
        bucket = ((packed ^ np.uint32(size * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        total += np.bincount(owner[:m][own] * BUCKETS + bucket[own], minlength=n * BUCKETS)
    total = total.reshape(n, BUCKETS)
    return np.sqrt(total / np.maximum(total.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def train_svm(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Linear SVMs (squared hinge, ridge): a weight column per column of ``sign``, the bias last.

    ``sign`` is 1 or -1 by a row's side, 0 if it takes no part. Sides weigh alike. Accelerated
    gradient descent from 0, a fixed number of steps.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = (np.where(sign > 0, 0.5 / np.maximum((sign > 0).sum(0), 1), 0.5 / np.maximum((sign < 0).sum(0), 1))
             * (sign != 0)).astype(np.float32)
    w = seen = np.zeros((x.shape[1], sign.shape[1]), np.float32)
    rate = 1.0 / (4.0 + RIDGE)  # rows have length sqrt(2), shares add up to 1
    for step in range(STEPS):
        slack = np.maximum(0.0, 1.0 - sign * (x @ seen))
        grown = seen - rate * (RIDGE * seen - 2.0 * x.T @ (share * sign * slack))
        seen = grown + step / (step + 3.0) * (grown - w)
        w = grown
    return w


def one_to_rest(y: np.ndarray, classes: list[str]) -> np.ndarray:
    """Sides of one machine per class: the class against all others."""
    return np.where(y[:, None] == np.array(classes, object)[None], 1.0, -1.0).astype(np.float32)


def one_to_one(y: np.ndarray, classes: list[str]) -> np.ndarray:
    """Sides of one machine per pair of classes, in the order of ``combinations``."""
    sides = [np.where(y == a, 1.0, np.where(y == b, -1.0, 0.0)) for a, b in combinations(classes, 2)]
    return np.stack(sides, axis=1).astype(np.float32)


@dataclass
class Model:
    """The families' machines and each family's pairs; a family of one language needs none."""

    families: list[str]
    members: dict[str, list[str]]
    top: np.ndarray | None
    inner: dict[str, np.ndarray]

    @staticmethod
    def _shares(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        margin = SHARPNESS * (x @ w[:-1] + w[-1])
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @staticmethod
    def _duels(x: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language with most votes of ``n``, and its share."""
        margin = np.zeros((len(x), n, n))
        for pair, (i, j) in enumerate(combinations(range(n), 2)):
            margin[:, i, j] = x @ w[:-1, pair] + w[-1, pair]
            margin[:, j, i] = -margin[:, i, j]
        votes, total = (margin > 0).sum(axis=2), margin.sum(axis=2)
        won = np.where(votes == votes.max(axis=1, keepdims=True), total, -np.inf).argmax(axis=1)
        own = margin[np.arange(len(x)), won]
        # The winner's zero margin with itself adds the 1.
        return won, 1.0 / np.exp(np.minimum(-2.0 * SHARPNESS * own, 500.0)).sum(axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = self._shares(x, self.top) if self.top is not None else np.ones((len(x), 1))
        best = top.argmax(axis=1)
        label = np.empty(len(x), object)
        score = top[np.arange(len(x)), best]
        for i, family in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            codes = self.members[family]
            if family not in self.inner or not len(rows):
                label[rows] = codes[0]
                continue
            won, share = self._duels(x[rows], self.inner[family], len(codes))
            label[rows] = np.array(codes, object)[won]
            score[rows] *= share
        return label, score


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more,
                       F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letters"),
                       F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def train(labelled: DataFrame, families: Mapping[str, str] = FAMILIES, max_train: int = MAX_TRAIN) -> Model | None:
    """Learns from a bounded sample of (doc_id, text, lang) rows; None if there is nothing to learn."""
    usable = _texts(labelled, F.col("lang")).where("lang is not null and _letters").drop("_letters")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    quota = max(1, max_train // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) / 1_000_000
    rate = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, quota / n)]), F.col("lang"))
    sample = usable.where(draw < rate).limit(2 * max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in chunks(batch, most=256):
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, n),
                     pa.array([v.tobytes() for v in features(data, ends)], pa.binary())], names=["lang", "x"])
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(lang, x) for batch in batches for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fit(sorted(got), families))], pa.binary())], names=["model"])
    sampled = sample.select("lang", "text").mapInArrow(run, "lang string, x binary")
    # One task holds the bounded sample; only the machines' weights come to the driver.
    model = sampled.repartition(1).mapInArrow(learn, "model binary").collect()
    return Model(*pickle.loads(model[0]["model"])) if model else None


def _fit(order: list[tuple[str, bytes]], families: Mapping[str, str]) -> tuple:
    """The parts of a ``Model`` of the sample's rows (language, features)."""
    y = np.array([lang for lang, _ in order], object)
    x = np.frombuffer(b"".join(v for _, v in order), np.float32).reshape(len(y), BUCKETS)
    family = np.array([families.get(lang, lang) for lang in y], object)
    names = sorted(set(family))
    members = {f: sorted(set(y[family == f])) for f in names}
    return (names, members, train_svm(x, one_to_rest(family, names)) if len(names) > 1 else None,
            {f: train_svm(x[family == f], one_to_one(y[family == f], m)) for f, m in members.items() if len(m) > 1})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in chunks(batch, most=256):
                n = len(ends) - 1
                some = np.asarray(batch.column(1).slice(rows.start, n))
                label, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if model is not None and some.any():
                    told, sure = model.predict(features(data, ends))
                    label, score = np.where(some, told, UNKNOWN), np.where(some, sure, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, n), pa.array(label, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])
    return _texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without texts of unknown language.

    Rejected are ``und`` and what scores under ``min_score``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.asarray(batch.column("_letters")) & (model is not None)
            for rows, data, ends in chunks(batch, "_lowered", most=256):
                if keep[rows].any():
                    keep[rows] &= model.predict(features(data, ends))[1] >= min_score
            yield batch.drop_columns(["_letters", "_lowered"]).filter(pa.array(keep))
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.withColumn("_letters", text.rlike("\\p{L}")).withColumn("_lowered", F.lower(text))
            .mapInArrow(run, docs.schema))
