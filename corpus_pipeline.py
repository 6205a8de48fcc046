"""From documents to packed sequences in five stages, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import packing, quality, recompression, shingles, toxicity
from ontoloom.llm._shared import split_of, stash, table


# All stages but the last return the columns of docs, extra ones included.  Rows with the same doc_id and text are the
# same document to every stage; an empty table stays empty.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it learns from the labelled documents of sf_dir.

    A null text is judged as an empty one; a row without doc_id is judged like any other, repeated rows each alike.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), split_of(F.col("doc_id"), 5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of sf_dir.

    Nulls and repeated rows as in drop_toxic().
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), split_of(F.col("doc_id"), 4) != 2)
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    Texts without words, null ones among them, are alike.  Of rows that repeat a doc_id one stays; rows without doc_id
    stay.
    """
    return shingles.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeat an earlier document; n_chars follows the text.

    A null text becomes empty; a row without doc_id keeps its words, and repeated rows lose the same.
    """
    kept = recompression.remove_repeats(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence.

    A null text is packed as an empty one; every row is packed, repeated ones and those without doc_id too.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: SQL can express neither the models nor the fingerprints nor the tokens; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
