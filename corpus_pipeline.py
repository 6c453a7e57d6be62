"""Corpus pipeline: filter, deduplicate, redact, mix and encode documents.

Every stage takes all rows that the one before it kept. All but the last
return the columns of documents as they came, but for the text and n_chars of
redacted ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairngraph.llm import mixing, neardup, quality, secrets, sentencepiece_codec
from cairngraph.llm.common import cut
from cairngraph.llm.queries import MODEL


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns used, and all others in one struct ``row``, whose names meet none of an operator's own."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))


def _whole(docs: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """The columns that _apart took apart, in their order."""
    return docs.select(*[F.col(c) if c in used else F.col(f"row.`{c}`") for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade keeps, unchanged."""
    return _whole(quality.quality(_apart(docs, "text")).where("kept"), docs.columns, "text")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (0.8), one row each.

    Rows that share a doc_id are one document, of which the first row in the
    order of its columns stays. Rows without a doc_id go.
    """
    leads = neardup.near_duplicates(docs, num=80, den=100).where("kept").select("doc_id").distinct()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("row"))
    kept = _apart(docs, "doc_id").join(leads, "doc_id", "left_semi").withColumn("first", first).where("first = 1")
    return _whole(kept, docs.columns, "doc_id")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of every secret and n_chars, where there is such a column, counted anew."""
    found = secrets.scan(_apart(docs, "text"), secrets.train(docs))
    clean = found.select("row", secrets.redact(F.col("text"), F.col("spans")).alias("text"))
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    return clean.select(*[F.col("text") if c == "text" else n_chars if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources reads them, at most three times each."""
    return mixing.copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, n_tokens, ids."""
    return sentencepiece_codec.encode_decode(docs, MODEL).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The encoding has no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's rows being stored before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs
