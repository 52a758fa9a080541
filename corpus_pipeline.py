"""From raw documents to sampled token ids: the training-text operators in a row.

Every stage takes the documents that its predecessor left, and its decisions take effect:

1. quality: documents scored below 0.5 go;
2. near duplicates: of every component of SimHash fingerprints, with the shingle length
   and bit distance of the operator, the document with the smallest doc_id stays;
3. repeated passages: bytes of 200-byte strings that start elsewhere too are taken out of
   the texts; the rows stay, with whatever text is left;
4. decontamination: documents that overlap a benchmark item go;
5. encoding: sampled SentencePiece segmentations of every text, with their ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trendgap.llm import decontamination, quality, segmentation, simhash, suffixes
from trendgap.llm.common import discard, read, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return segmentation.sample_segmentations(docs, model)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("sentencepiece encoding", sentencepiece_encoding),
]

# Learnt scores, samples and passages cut byte by byte are not for SQL; tests/llm holds
# every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        given, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(given)
    return docs
