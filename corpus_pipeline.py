"""The training-data pipeline: STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.

Each stage works on what the one before kept; all but the last return the columns of documents. Null and empty texts
have no language and go in the first stage; a document that loses all its lines goes in the second; columns beyond those of
documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import bpe, decontaminate, language, line_dedup, near_dedup
from wayfare.llm.common import crc_mod, cut


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter) go."""
    model = language.train(docs, crc_mod(F.col("doc_id"), 3) != 1)
    names = ("_pipeline_lang", "_pipeline_score", "_pipeline_cosine")
    return language.identify(docs, model, names).where(F.col(names[0]) != "und").select(docs.columns)


def dedup_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go, but in the last document that holds them; a document that loses all its lines goes too."""
    counts = ("_pipeline_lines", "_pipeline_dropped")
    out = line_dedup.drop_common_lines(docs, names_of_counts=counts)
    out = out.where((F.col(counts[1]) == 0) | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs).select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which an item of the benchmark leaks go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them."""
    import public_tokenizers

    out = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: Language profiles, near-dedup and BPE are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
