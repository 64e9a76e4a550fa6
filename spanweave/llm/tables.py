"""Reading the tables that the queries of this subpackage use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .unicode_forms import canonical_column

#: What a cut may leave at the end of a text, Java regex: an ellipsis, a replacement character,
#: part of a character reference or of an escape.
CUT_MARKS = "(?:\\u2026|\\.\\.\\.|\\ufffd+|&(?:#?[A-Za-z0-9]{0,7})|\\\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)\\s*$"


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, one row per ``context_id``, with ``context`` in the usual spelling."""
    p = read_table(spark, sf_dir, "paragraphs", "context_id", "context", "source")
    return canonical_column(p, "context", "usual").select(
        "context_id", F.col("usual").alias("context"), "source"
    ).dropDuplicates(["context_id"])


def answers_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with its question and passage, all in the usual spelling.

    Columns: answer_id, qa_id, text, usual (the answer), answer_start, question, is_impossible
    (null read as false), context, source. The passage is shuffled once, on ``context_id``.
    """
    a = read_table(spark, sf_dir, "answers", "answer_id", "qa_id", "text", "answer_start").dropDuplicates(["answer_id"])
    a = canonical_column(a, "text", "usual")
    q = read_table(spark, sf_dir, "qas", "id", "context_id", "question", "is_impossible").dropDuplicates(["id"])
    q = canonical_column(q, "question", "q").select(
        F.col("id").alias("qa_id"), "context_id", F.col("q").alias("question"),
        F.coalesce("is_impossible", F.lit(False)).alias("is_impossible"),
    )
    return a.join(q, "qa_id").join(contexts(spark, sf_dir), "context_id")
