"""From raw documents to packed sequences: five stages, each written to the shared folder and read again by the next.

Defined cases, for every stage: a null or empty text is no reason to fail (quality rules reject it); repeated rows and
equal or null doc_ids are handled as the stage's operator says; an empty table gives an empty one; columns other than
doc_id and text are carried through all but the last stage, whatever their names, apart from n_chars, which follows the
text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import decontaminate, jaccard_join, linededup, packing, quality
from sparquill.llm._common import discard, table, tidy


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule of the policy passes."""
    return quality.keep_good(docs, "corpus")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; a document left without a word goes, as a copy."""
    out = linededup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack_sequences),
]

#: The tokenizer of the last stage has no SQL; tests check run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        last, docs = docs, tidy(stage)(spark, docs, sf_dir)
        discard(last)  # a stage's table goes once the next is written
    return docs
