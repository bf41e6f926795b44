"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    ann, crosstok, decontam, hardneg, html, langid, licenses, lines, minhash, mixing, substring, suffix, toxicity)
from shelfwise.llm.common import table

# Where the public vocabularies of op13 lie.
TOKENIZERS = "/opt/tokenizers"


def _fold(of: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``of`` (a null id is in fold 0)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(0))


Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph and sentence dedup of ``documents``: removed units, their offsets, and the digest of the rest."""
    done = substring.remove(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return done.select("doc_id", "n_units", "n_removed", "n_chars_removed", spans.alias("spans"), "kept_sha256")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents`` by BagMinHash and verified overlap."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` inside a 100-byte string that starts earlier, by suffix arrays."""
    return suffix.remove(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all ``embeddings`` to each whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents`` to target weights, in training order; a position for each of up to three readings."""
    return mixing.curriculum(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "position",
        *(F.get("positions", F.lit(e)).alias(f"position_{e + 1}") for e in (1, 2)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a copy of a ``benchmark`` item, the item, and the alignment's score."""
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of ``documents`` through cuckoo filters and exact reference counts."""
    done = lines.dedup_corpus(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the labelled ones outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(4) != 2))
    return langid.predict(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by tree scoring."""
    return html.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside fold 1 of 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(_fold(3) != 1))
    return toxicity.predict(docs, lexicon).select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_hits")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages of all ``documents`` by diagonal voting."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the ``embeddings`` whose vec_id is divisible by 50, among all of them."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hardneg.usable(table(spark, sf_dir, "embeddings"), moved)
    return hardneg.mine(rows, rows.where(F.col("vec_id") % 50 == 0))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all ``documents`` under a byte-level and a sentence-piece vocabulary."""
    return crosstok.align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json",
                          f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}
