"""From raw documents to packed training sequences: five stages, each a written table for the next.

1. quality: documents that the classifier rejects go.
2. exact dedup: of equal texts one stays.
3. near dedup: of documents alike in five-word shingles (similarity 0.8 or more) one stays.
4. substrings: passages of 50 words and more that an earlier document has go.
5. packing: the tokens of what is left, in sequences of 4096.

Null texts count as empty. What the first stage does with a text of few or no words is decided by its statistics; equal
texts are one to the second stage, also empty ones and those that differ in white space only; the next two leave texts
without words, or shorter than a window, as they are; the last gives an empty text one token. Texts of any length are read
whole by every stage. Of equal or near rows one stays: the longest original and then the smallest doc_id among equal
texts, the smallest doc_id (null last) and then a hash of the row among near ones, so repeated rows and ties
fall out alike on every run. A document without an id can stay or go like any other. Further columns, whatever their names, are
carried through to the last stage, which returns columns of its own. A table without rows passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.llm.common import documents, written
from ionloom.llm.exact_dedup import dedup_documents
from ionloom.llm.labelled import training_labels
from ionloom.llm.near_dup import near_dedup_documents
from ionloom.llm.packing import pack_documents
from ionloom.llm.quality import quality_filter
from ionloom.llm.substrings import substring_dedup_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without those that the quality classifier rejects."""
    return quality_filter(docs, training_labels(spark, sf_dir, "quality", 3, 1))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with one row of each group of equal texts."""
    return dedup_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with one document of each group of near copies."""
    return near_dedup_documents(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without repeated passages; text and n_chars change."""
    return substring_dedup_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: A classifier and a tokenizer take part, which SQL does not express; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of `sf_dir`."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage-{number + 1}")
    return docs
