"""Corpus pipeline over the documents table: quality, language, exact and near copies, packing.

Every stage takes (spark, docs, folder of tables) and returns a DataFrame, which is written as
Parquet and read again as the next one's input. All but the last return the columns they got.

Defined results, for every stage: null text counts as empty; an empty table gives an empty table; columns beside
doc_id, text and lang are carried whatever their names, and do not influence a decision. Rows with a null id are
judged by their text: the quality and language stages learn nothing from them, exact dedup takes them as smaller and near-dedup as
larger than any id, which also never drops them. Rows that repeat id and text are one document, of which exact dedup
leaves one; rows that share an id but not the text are documents of their own. Ties are impossible beyond that: of
equal texts the largest id stays, of near ones the smallest. Empty texts have no letters, so language ID drops them; were they
to come further, they would be exact copies of each other and near copies of nothing, and be packed as one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm import exact, language, minhash, packing, quality
from siftframe.llm.queries import small_batches, table, tokenizer_path
from siftframe.work import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from two thirds of the labels."""
    small_batches(spark)
    learned = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), learned))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text."""
    small_batches(spark)
    learned = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return language.identify(docs, language.fit(docs, learned))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    small_batches(spark)
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a Jaccard of 0.8 the document with the least id."""
    small_batches(spark)
    return minhash.drop_near(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("language id", known_language),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("packing", packed),
]

#: SQL cannot express the classifiers and the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
