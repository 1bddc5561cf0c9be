"""Corpus pipeline: stages applied in order, each written as Parquet and read back as the next one's documents.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Columns
beyond these are left out by every stage, whatever their names; an empty table stays empty; very long
texts are worked on whole. What a stage does with nulls, empty texts, repeated rows and ties stands in
its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard, langid, pieces, substrings
from siltstone.runtime import stage_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language (null texts and texts without a letter); fill in missing languages.

    A known ``lang`` stays as it is; a null one gets the predicted language, of equal scores the
    alphabetically first. Where no language can be learnt, as no row is labelled, null ones stay null.
    Empty texts go, as they have no letter; repeated rows are judged each; rows with a null id stay.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    if model is None:
        return langid.lettered(docs)
    return langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN).select(
        "doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars"
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Of rows with equal id and text one stays; rows with one id and different texts are judged each by
    its own text; null and empty texts are near nothing; rows with a null id stay.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 13 words and more that a document with a smaller id holds too.

    Rows with one id do not cut each other; rows with a null id are neither cut nor cut others; null
    and short texts stay as they are. ``n_chars`` is counted anew.
    """
    cut = substrings.dedup_texts(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``.

    Null and empty texts hold nothing, null and empty items are held by nothing; every row is searched,
    whatever its id; an empty benchmark drops nothing.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the text that they decode to.

    Null and empty texts have no pieces and an empty text; of equal segmentations the one with the
    longer last piece is taken; every row is encoded, whatever its id.
    """
    done = pieces.round_trip(docs)
    return done.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "text")


STAGES = [
    ("language id", language),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", leaks),
    ("sentence pieces", tokens),
]

#: Language models, edit distances and segmentations are not SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
