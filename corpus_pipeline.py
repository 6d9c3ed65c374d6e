"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` applies them one after another; each
result is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.bpe import bpe_round_trip, vocabulary_path
from arcwell.llm.common import kept, table
from arcwell.llm.langid import in_known_languages
from arcwell.llm.mixing import mixed_documents
from arcwell.llm.near_texts import without_near_texts
from arcwell.llm.suffixes import deduplicated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know; what is likelier no language at all goes."""
    return in_known_languages(docs.select(*COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest doc_id.

    Candidates come from the SimHash index and, as no fingerprint distance is certain at
    0.8, from a prefix filter; the shingles themselves decide.  Rows without a doc_id stay.
    """
    return without_near_texts(docs.select(*COLUMNS))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier text, or the same before, has in 100 bytes or more."""
    return deduplicated(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of the sources to their target weights takes."""
    return mixed_documents(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text again."""
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    return bpe_round_trip(rows, vocabulary_path())


STAGES = [
    ("language id", known_languages),
    ("simhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("source mix", mixed),
    ("bpe", encoded),
]

#: SQL can express no stage of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
