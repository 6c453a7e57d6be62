"""Registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, html_extract, lexical, licenses, lm_scoring, mixing, neardup, quality, secrets, sentencepiece_codec, topk, toxicity, warc
from .common import table, words

MODEL, BYTE_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality; background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score_against(table(spark, sf_dir, "documents"), good)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by sign codes, of each whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/<thousands of doc_id>/<doc_id>.

    A document with a notice and at most 100 words speaks for its directory.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    folder = F.concat_ws("/", name("source"), name("lang"), F.coalesce(F.expr("cast(doc_id div 1000 as string)"), F.lit("none")))
    files = docs.select("doc_id", F.concat_ws("/", folder, name("doc_id")).alias("path"), "text")
    scanned = licenses.scan(files, license_file=F.size(words(F.col("text"))) <= 100)
    return scanned.select("doc_id", "path", "own_license", "own_score", "license", "license_from", "license_depth")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), MODEL)
    digest = lambda c: F.sha2(c, 256)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents"), BYTE_BPE, MODEL)


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_lm_scoring, op3_html_extraction, op4_quality_rules, op5_secret_scan, op6_exact_top_k, op7_license_scan, op8_toxicity, op9_minhash_near_dedup, op10_sentencepiece, op11_warc, op12_lexical_search, op13_token_alignment)}

ORACLES = {"op1_source_mixing": mixing.ORACLE, "op4_quality_rules": quality.ORACLE, "op6_exact_top_k": topk.ORACLE, "op12_lexical_search": lexical.ORACLE}
