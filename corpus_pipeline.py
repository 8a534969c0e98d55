"""A corpus pipeline of four stages: language ID, line dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_staged, read_table, stage, staged_into
from pulsegrid.llm.language_id import UNKNOWN, identify, learn_filters
from pulsegrid.llm.line_dedup import dedup_lines
from pulsegrid.llm.ngram_join import Measure, keep_one
from pulsegrid.llm.packing import Limits, pack_documents
from pulsegrid.llm.queries import PACK_END, WORD_TOKENIZER, vocabulary

# A text is in none of the learned languages if the share of its grams that its language has is smaller than this part of
# the usual share, that of the language's own training texts.
LEAST_KNOWN = 0.2
NEAR = Measure(words=5, percent=80)
# Besides the tokens, so that a sequence is not filled with a great many tiny documents. A cost limit below the square of
# the tokens would cut long documents into smaller pieces, so there is none.
PACK_LIMITS = Limits(documents=64)
OWN = "__stage_"  # stands before columns that a stage adds for itself


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in no learned language.

    The languages are learned from all rows with text and lang. Where none is learned nothing can be told apart, and
    every document with a text stays; null texts always go.
    """
    filters = learn_filters(docs)
    if not filters.languages:
        return docs.where(F.col("text").isNotNull())
    # A literal map, not a Python function, which would start more workers beside those of identify.
    least = F.create_map(*(F.lit(x) for pair in zip(filters.languages, (LEAST_KNOWN * filters.usual).tolist(), strict=True) for x in pair))
    judged = identify(docs, filters, prefix=OWN)
    enough = F.col(f"{OWN}known") >= F.element_at(least, F.col(f"{OWN}pred"))
    return judged.where((F.col(f"{OWN}pred") != UNKNOWN) & enough).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document of which all was repeated elsewhere goes. ``n_chars`` follows the text."""
    cleaned = dedup_lines(docs, prefix=OWN)
    cleaned = cleaned.where((F.col(f"{OWN}removed_chunks") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(f"{OWN}removed_chunks") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", changed)
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id: five-word shingles, similarity 0.8.

    Null texts and texts without words are in no group and stay; of rows alike in id and text one stays. An empty table
    stays empty. All columns are kept as they are, whatever their names.
    """
    return keep_one(docs, NEAR)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens and 64 pieces.

    A null or empty text is the one piece that holds the end token; repeated rows are packed each; an empty table has no
    pieces. Only id and text are read, so other columns' names cannot clash with those of the pieces.
    """
    return pack_documents(docs, vocabulary(WORD_TOKENIZER), PACK_END, PACK_LIMITS)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]

# Language ID cannot be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the result is a stored table of its own.

    What a stage leaves in the shared folder goes once its result is written, and so does the table it read. Nothing is
    kept outside the call, so several runs stand side by side, and settings of the session are not touched.
    """
    docs, read = read_table(spark, sf_dir, "documents"), []
    for name, function in STAGES:
        left: list[str] = []
        written: list[str] = []
        try:
            with staged_into(left):
                made = function(spark, docs, sf_dir)
            with staged_into(written):
                docs = stage(made, name)
        finally:
            drop_staged(spark, left)
            drop_staged(spark, read)
        read = written
    return docs
