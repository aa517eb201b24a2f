"""Four stages from raw documents to token ids; each reads what the one before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.llm import mixing, queries, sketches, toxicity, wordbpe
from stopflow.llm.shipping import ship
from stopflow.session import passing, stored

# Text bytes of a block in the last stage: its tasks run in executors that other stages have filled.
ENCODE_BLOCK_BYTES = 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the calibrated threshold of their language.

    The model learns from all labels. A missing text scores as an empty one, a missing language
    has the common threshold, and rows without doc_id or repeated rows are judged each alike. Other
    columns pass through whatever their names; an empty table stays empty.
    """
    ship(spark)
    model = queries.toxicity_model(spark, sf_dir, F.lit(True))
    score = "_score"
    while score in docs.columns:
        score += "_"
    scored = toxicity.with_scores(docs, model, into=score)
    return scored.where(F.col(score) < toxicity.threshold(model)).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together; rows without doc_id stay,
    and so do documents without a word. Other columns pass through; an empty table stays empty.
    """
    ship(spark)
    with passing(spark):
        groups = sketches.near_duplicates(docs, words=5, percent=80)
        # Stored, so that the join sees how few there are and leaves the texts where they lie.
        few = groups.where("NOT kept").select("doc_id").distinct()
        gone = stored(few, "gone", outlive=True)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source meets its share of all words.

    A missing text has no words, a missing source is a source of its own, and rows are taken apart
    by the hash of their doc_id, a missing one included. Other columns pass through; an empty table
    stays empty.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every row, as digests.

    A missing text has no ids and decodes to an empty one; rows without doc_id and repeated rows are rows
    like any other, and an empty table gives none.
    """
    ship(spark)
    return queries.encoded_digests(docs, ENCODE_BLOCK_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# The classifier cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each stage's rows written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    return functools.reduce(
        lambda rows, stage: stored(stage[1](spark, rows, sf_dir), stage[0]), STAGES, docs
    )
