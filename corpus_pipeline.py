"""From raw documents to tokens: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes the documents that the one before kept, whole, and returns what it keeps in the columns of
documents; the last returns token counts, ids and digests. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatecast.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from slatecast.llm.shared import materialise, ship, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letter, or a score under the calibrated threshold."""
    ship(spark)
    return language_id.known_languages(docs, docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the lines of three-line windows that occurred before; documents stay, emptied ones with empty text."""
    ship(spark)
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digests of ids and of the decoded text."""
    ship(spark)
    return bpe.with_public_ranks(docs, ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language id", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("byte bpe", tokenize),
]

#: SQL can't express the stages; tests hold them against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents table, each to what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
    return docs
