"""The queries of problems tagged llm, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table
from . import pair_defects, truncation
from .chunks import split_texts
from .cross_split import cross_split_pairs, pairs_per_record
from .mixing import mix
from .packing import fill_report, pack
from .personal_data import find_items, fit_finder, propose, redact
from .sentence_alignment import aligned_sentences
from .tables import answers_in_context, contexts
from .unicode_forms import lookalike_rows


def _texts(spark: SparkSession, d: str) -> list[tuple[str, str, str, DataFrame]]:
    return [
        ("paragraphs", "context_id", "context", read_table(spark, d, "paragraphs", "context_id", "context")),
        ("answers", "answer_id", "text", read_table(spark, d, "answers", "answer_id", "text")),
    ]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    contexts_once = read_table(spark, d, "paragraphs", "context_id", "context").dropDuplicates(["context_id"])
    return split_texts(contexts_once, "context_id", "context", limit=500, overlap=100)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        lookalike_rows(df, text, key).select(F.lit(tab).alias("tab"), F.col(key).cast("string").alias("row_id"))
        for tab, key, text, df in _texts(spark, d)
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p2_respelled(spark: SparkSession, d: str) -> DataFrame:
    """Every changed text with its usual spelling."""
    parts = [
        lookalike_rows(df, text, key).select(
            F.lit(tab).alias("tab"), F.col(key).cast("string").alias("row_id"), "canonical"
        )
        for tab, key, text, df in _texts(spark, d)
    ]
    return parts[0].unionByName(parts[1]).dropDuplicates(["tab", "row_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links = aligned_sentences(read_table(spark, d, "paragraphs", "context_id", "orig_context_id", "context"))
    return links.select(
        F.col("source_id").alias("en_context_id"), F.col("source_sent").alias("en_sent"),
        F.col("target_id").alias("te_context_id"), F.col("target_sent").alias("te_sent"),
    )


def _cut_contexts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(read_table(spark, d, "paragraphs", "context_id", "context", "source"), "context_id", "context")


def _judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, source, open, chars, bytes, inside, partial) of every answer."""
    a = truncation.with_lengths(answers_in_context(spark, d), "text")
    usual, context = F.col("usual"), F.col("context")
    return materialize(a.select(
        F.col("answer_id").cast("string").alias("row_id"), "source", "open", "chars", "bytes",
        truncation.stops_inside_word(usual, context, F.col("answer_start")).alias("inside"),
        truncation.last_word_is_part(usual, context).alias("partial"),
    ), "judged")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut_contexts(spark, d).select(F.lit("paragraphs").alias("tab"), "row_id").unionByName(
        truncation.cut_answers(_judged_answers(spark, d)).select(F.lit("answers").alias("tab"), "row_id")
    )


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """For each source and tab (paragraphs, answers): texts, cut texts and their share.

    An answer has the source of its paragraph.
    """
    source = F.coalesce("source", F.lit("")).alias("source")
    judged = _judged_answers(spark, d)
    sides = {
        "paragraphs": (read_table(spark, d, "paragraphs", "context_id", "source").dropDuplicates(["context_id"]), _cut_contexts(spark, d)),
        "answers": (judged, truncation.cut_answers(judged)),
    }
    parts = [
        all_.groupBy(source).agg(F.count("*").alias("n_texts"))
        .join(cut.groupBy(source).agg(F.count("*").alias("n_cut")), "source", "left")
        .select("source", F.lit(tab).alias("tab"), "n_texts", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
        for tab, (all_, cut) in sides.items()
    ]
    return parts[0].unionByName(parts[1]).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "qas", "id", "is_impossible").select(
        F.col("id").alias("qa_id"), F.coalesce("is_impossible", F.lit(False)).alias("is_impossible")
    ).dropDuplicates(["qa_id"])
    return pair_defects.defects(answers_in_context(spark, d), q)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("defect is not null").select("qa_id", "defect").distinct()


def p6_fired(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that fires, per defective answer (null answer_id: the question has no answer)."""
    return _defects(spark, d).select("qa_id", "answer_id", F.explode("fired").alias("fired"))


def _texts_by_split(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, dict]]:
    """Per kind the records (id, split, text) and the definition of a pair."""
    return {
        "context": (read_table(spark, d, "paragraphs", "context_id", "split", "context").toDF("id", "split", "text"),
                    {"width": 4, "similarity": 0.5, "least_words": 30}),
        "question": (read_table(spark, d, "qas", "id", "split", "question").toDF("id", "split", "text"),
                     {"width": 1, "similarity": 0.85, "agree": 2, "common_share": 0.0005}),
    }


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        cross_split_pairs(df, **how).select(F.lit(kind).alias("kind"), F.least("train_id", "eval_id").alias("id_1"), F.greatest("train_id", "eval_id").alias("id_2"))
        for kind, (df, how) in _texts_by_split(spark, d).items()
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs of contexts and of questions per evaluation split and source.

    A question has its own split, and the source of its paragraph.
    """
    p = read_table(spark, d, "paragraphs", "context_id", "split", "source").dropDuplicates(["context_id"])
    q = read_table(spark, d, "qas", "id", "context_id", "split").dropDuplicates(["id"])
    rows = p.select(F.lit("context").alias("kind"), F.col("context_id").alias("eval_id"), "split", "source").unionByName(
        q.join(p.select("context_id", "source"), "context_id", "left")
        .select(F.lit("question").alias("kind"), F.col("id").alias("eval_id"), "split", "source")
    )
    parts = [pairs_per_record(df, **how).withColumn("kind", F.lit(kind)) for kind, (df, how) in _texts_by_split(spark, d).items()]
    return (
        parts[0].unionByName(parts[1]).join(rows, ["kind", "eval_id"])
        .groupBy("kind", "split", F.coalesce("source", F.lit("")).alias("source"))
        .agg(F.sum("n_pairs").alias("n_pairs"), F.count("*").alias("n_records"))
    )


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(read_table(spark, d, "documents", "doc_id", "text", "source"), capacity=512)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_containers(spark, d), 512)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text", "source")
    return mix(docs, read_table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text", "source")
    return mix(docs, read_table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "given_names", "given_name")
    proposals = propose(read_table(spark, d, "documents", "doc_id", "text"), names)
    return find_items(proposals, fit_finder(proposals, names)).select("doc_id", "kind", "char_start")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs, names = read_table(spark, d, "documents", "doc_id", "text"), read_table(spark, d, "given_names", "given_name")
    return redact(docs, fit_finder(propose(docs, names), names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        k: v for k, v in globals().items()
        if k[:1] == "p" and k[1:2].isdigit() and callable(v)
    }


def oracle_sql() -> dict[str, str]:
    return {}
