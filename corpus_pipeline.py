"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, piece encoding.

Every stage takes the documents that its predecessor kept and returns those it
keeps, with the columns of documents; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import contamination, language, linefreq, minhash, pieces
from weekloom.llm.queries import PIECE_MODEL, held_out_language
from weekloom.llm.tables import materialize, read_table, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; those without a letter (null and empty ones too), or far from all profiles, go. Repeated rows share one fate."""
    profiles = language.fit_profiles(docs.where(~held_out_language()))
    return language.keep_identified(docs, profiles, min_score=0.2)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    Copies of a text count as one page of their source. A document of which
    nothing but white space would stay keeps its whole text: if its lines are
    those of many near copies, near-dedup keeps one of them. Null and empty
    texts and repeated rows stay as they are.
    """
    before = unused(docs, "before")
    shorter = linefreq.drop_boilerplate(docs.withColumn(before, F.col("text")))
    shorter = shorter.withColumn("text", F.when(linefreq.is_blank("text"), F.col(before)).otherwise(F.col("text")))
    changed = F.col("text") != F.col(before)
    return shorter.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, linked from a similarity of 0.8 on.

    A pair at exactly 0.8 is missed with a chance of about 1.8e-4. Rows without
    an id or without words stay, rows that repeat a kept one too, and so does
    another text under the doc_id of a row that goes.
    """
    return minhash.drop_near_duplicates(docs, threshold=80, half_tables=13)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return contamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the text decoded from the ids; null becomes an empty text, repeated rows stay."""
    coded = pieces.encode_pieces(docs, PIECE_MODEL)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").alias("text"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("sentencepiece", encode)]

#: Neither language profiles nor MinHash nor the segmentation can be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
