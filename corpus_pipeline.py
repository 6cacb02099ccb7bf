"""The training-data pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm import line_dedup as lines
from loom.llm import mixing, ngram_join, packing
from loom.llm import toxicity as toxic
from loom.llm.common import documents, named, table, text_of, written


def _with_chars(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it has that column, as its text now is."""
    return docs.select(*[F.length(text_of()).cast("long").alias(c) if c == "n_chars" else named(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is not toxic.

    Defined cases: null and empty texts are scored by the intercept and stay while that is below the threshold;
    documents with a null id are scored like others; repeated rows go or stay together; without labels of both
    classes the score is the share of toxic labels; an empty table gives an empty one; columns may have any names."""
    return toxic.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share.

    Defined cases: a document that loses all its lines stays, with an empty text; a null text becomes empty; rows
    of equal ids are one document for the count, a null id one of its own; repeated rows get equal texts; an empty
    table gives an empty one; columns may have any names."""
    return _with_chars(lines.deduplicated(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; rows equal in id and text are one document.

    Defined cases: documents without words belong to no group and stay; a null id stays only where its group has no
    other; of several texts with the smallest id the one that has the smallest hash stays; an empty table gives an
    empty one; columns may have any names."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut keeps its first words.

    Defined cases: a document without words is not taken; a null source is a source of its own; repeated rows are
    taken each by itself; an empty table gives an empty one; columns may have any names."""
    return _with_chars(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, as op2 returns them.

    Defined cases: null and empty texts are the end id alone; a null id passes through; repeated rows are packed
    each by itself; an empty table gives an empty one; other columns play no part."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned scores, min-hashes and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
