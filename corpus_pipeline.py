"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before kept; its result is written as Parquet and read again.
``run`` needs the tables ``documents``, ``labels`` and ``benchmark``; it returns the pieces of the
packed sequences. No SQL can state the trained first stage or the tokenizer of the last one, so the
pipeline has no oracle; its tests compare every stage with brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meteoqc.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from meteoqc.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores 0.5 or more."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.first_of_groups(docs)


#: bytes of a repeated string; a passage of over 50 words has about 300 at least
REPEATED_BYTES = 250


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of ``REPEATED_BYTES`` bytes and more that occur again."""
    return suffix_dedup.without_repeats(docs, REPEATED_BYTES)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences of the corpus's source mixture."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
