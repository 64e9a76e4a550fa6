"""Shared frames of the question-answering tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NOT_WORD_OR_WS, WS
from ..session import read_table


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(
        spark, d, "paragraphs", "context_id", "article_id", "title", "split", "source", "lang", "para_no", "orig_context_id", "context"
    ).dropDuplicates(["context_id"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "qas", "id", "context_id", "article_id", "split", "question", "is_impossible").dropDuplicates(["id"])
    return q.withColumn("is_impossible", F.coalesce("is_impossible", F.lit(False)))


def answers(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "answers", "answer_id", "qa_id", "article_id", "answer_no", "is_plausible", "text", "answer_start")
    return a.dropDuplicates(["answer_id"]).withColumn("is_plausible", F.coalesce("is_plausible", F.lit(False)))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Every answer with its question's flag and its passage."""
    q = questions(spark, d).select(F.col("id").alias("qa_id"), "context_id", "split", "is_impossible")
    p = paragraphs(spark, d).select("context_id", "context", "source")
    return answers(spark, d).drop("article_id").join(q, "qa_id").join(p, "context_id")


def examples(spark: SparkSession, d: str) -> DataFrame:
    """Every question with its passage, its first and last answer and its first plausible one."""
    a = answers(spark, d)
    up = Window.partitionBy("qa_id", "is_plausible").orderBy("answer_no", "answer_id")
    down = Window.partitionBy("qa_id", "is_plausible").orderBy(F.desc("answer_no"), F.desc("answer_id"))
    r = a.withColumn("rn", F.row_number().over(up)).withColumn("rl", F.row_number().over(down)).where("rn = 1 or rl = 1")

    def pick(cond: str, column: str, name: str):
        return F.max(F.when(F.expr(cond), F.col(column))).alias(name)

    one = r.groupBy(F.col("qa_id").alias("id")).agg(
        pick("not is_plausible and rn = 1", "text", "first_text"), pick("not is_plausible and rn = 1", "answer_start", "first_start"),
        pick("not is_plausible and rl = 1", "text", "last_text"), pick("is_plausible and rn = 1", "text", "plausible_text"),
        F.max(((~F.col("is_plausible")) & (F.col("rn") == 1)).cast("int")).alias("has_answer"),
    )
    q = questions(spark, d).select("id", "context_id", "split", "question", "is_impossible")
    p = paragraphs(spark, d).select("context_id", "context", "source")
    e = q.join(one, "id", "left").withColumn("has_answer", F.coalesce("has_answer", F.lit(0)))
    return e.join(p, "context_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(id, split, model, gold, pred, question, context): two prediction sets of the same data.

    ``slice`` predicts what stands at the first answer's offset; ``last`` predicts the last
    answer, and a plausible one where there is none.
    """
    e = examples(spark, d)
    gold = F.when(F.col("is_impossible"), "").otherwise(F.coalesce("first_text", F.lit("")))
    cut = F.coalesce(F.substring("context", F.col("first_start") + 1, F.length("first_text")), F.lit(""))
    sliced = F.when(F.col("is_impossible"), "").when(F.col("first_start") >= 0, cut).otherwise("")
    last = F.when(F.col("is_impossible"), F.coalesce("plausible_text", F.lit(""))).otherwise(F.coalesce("last_text", F.lit("")))
    return e.select(
        "id", "split", "question", "context", gold.alias("gold"),
        F.explode(F.array(F.struct(F.lit("slice").alias("model"), sliced.alias("pred")), F.struct(F.lit("last").alias("model"), last.alias("pred")))).alias("m"),
    ).select("id", "split", "question", "context", "gold", "m.model", "m.pred")


# The same in SQL.

BASE = """
p AS (SELECT DISTINCT context_id, article_id, title, split, source, lang, para_no, orig_context_id, context FROM paragraphs),
q AS (SELECT DISTINCT id, context_id, article_id, split, question, coalesce(is_impossible, false) AS is_impossible FROM qas),
a AS (SELECT DISTINCT answer_id, qa_id, article_id, answer_no, coalesce(is_plausible, false) AS is_plausible, text, answer_start FROM answers),
spans AS (SELECT a.answer_id, a.qa_id, a.answer_no, a.is_plausible, a.text, a.answer_start, q.context_id, q.split, q.is_impossible, p.context, p.source
  FROM a JOIN q ON q.id = a.qa_id JOIN p ON p.context_id = q.context_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qa_id, is_plausible ORDER BY answer_no, answer_id) AS rn,
  row_number() OVER (PARTITION BY qa_id, is_plausible ORDER BY answer_no DESC, answer_id DESC) AS rl FROM a),
ex AS (SELECT q.id, q.question, q.is_impossible, q.split, p.context_id, p.context, p.source, f.text AS first_text, f.answer_start AS first_start,
  l.text AS last_text, s.text AS plausible_text, CASE WHEN f.qa_id IS NULL THEN 0 ELSE 1 END AS has_answer
  FROM q JOIN p ON p.context_id = q.context_id
  LEFT JOIN ranked f ON f.qa_id = q.id AND NOT f.is_plausible AND f.rn = 1
  LEFT JOIN ranked l ON l.qa_id = q.id AND NOT l.is_plausible AND l.rl = 1
  LEFT JOIN ranked s ON s.qa_id = q.id AND s.is_plausible AND s.rn = 1),
golds AS (SELECT *, CASE WHEN is_impossible THEN '' ELSE coalesce(first_text, '') END AS gold FROM ex),
sc AS (SELECT id, split, question, context, gold, 'slice' AS model,
  CASE WHEN is_impossible THEN '' WHEN first_start >= 0 THEN coalesce(substr(context, first_start + 1, length(first_text)), '') ELSE '' END AS pred FROM golds
  UNION ALL SELECT id, split, question, context, gold, 'last',
  CASE WHEN is_impossible THEN coalesce(plausible_text, '') ELSE coalesce(last_text, '') END FROM golds)
"""


def sql(body: str, *more: str) -> str:
    """``body`` after the shared expressions and ``more`` of them."""
    return "WITH " + ",\n".join([BASE.strip(), *more]) + "\n" + body


def sq_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sq_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> '')"


def sq_script(x: str) -> str:
    kept = f"regexp_replace(coalesce({x}, ''), '[^\\x{{c00}}-\\x{{c7f}}a-zA-Z0-9{WS[1:-1]}]', '', 'g')"
    return sq_squeeze(f"lower({kept})")


def sq_punctuation_first(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '{NOT_WORD_OR_WS}', '', 'g')"
    return f"array_to_string(list_filter({sq_tokens(bare)}, lambda t: t NOT IN ('a', 'an', 'the')), ' ')"


def sq_articles_first(x: str) -> str:
    word = r"[^\p{L}\p{N}_]"
    once = f"regexp_replace(%s, '(^|{word})(?:a|an|the)({word}|$)', '\\1 \\2', 'g')"
    return sq_squeeze(f"regexp_replace({once % (once % f'lower({x})')}, '{NOT_WORD_OR_WS}', '', 'g')")


def sq_blank(x: str) -> str:
    return f"(regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g') = '')"


def sq_em(p: str = "pred", g: str = "gold") -> str:
    return f"CAST({sq_script(p)} = {sq_script(g)} AS DOUBLE)"


def sq_f1(p: str = "pred", g: str = "gold") -> str:
    a, b = sq_tokens(sq_script(p)), sq_tokens(sq_script(g))
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN CAST(len({a}) = len({b}) AS DOUBLE) WHEN {both} = 0 THEN 0.0 "
        f"ELSE 2.0 * {both} / (len({a}) + len({b})) END"
    )


def sq_error(p: str = "pred", g: str = "gold") -> str:
    return (
        f"CASE WHEN {sq_em(p, g)} = 1 THEN 'Correct' WHEN {sq_blank(g)} AND NOT {sq_blank(p)} THEN 'Unanswerable FP' "
        f"WHEN NOT {sq_blank(g)} AND {sq_blank(p)} THEN 'Unanswerable FN' WHEN {sq_f1(p, g)} > 0 AND {sq_f1(p, g)} < 1 THEN 'Partial Span' "
        f"WHEN {sq_f1(p, g)} = 0 THEN 'No Overlap' ELSE 'Other' END"
    )


def sq_ngrams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({tokens}) - {n} + 2, 1)), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def sq_clipped(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda y: y = g)), len(list_filter({b}, lambda y: y = g))))), 0)"
    )


def sq_lcs(a: str, b: str) -> str:
    """Longest common subsequence of two lists, row by row of the usual table."""
    matches = f"list_transform({a}, lambda x: list_transform({b}, lambda y: CASE WHEN y = x THEN 1 ELSE 0 END))"
    cell = "CASE WHEN m[j[1]] = 1 THEN old[j[1]] + 1 ELSE greatest(old[j[1] + 1], new[j[1]]) END"
    row = f"list_reduce(list_prepend([0], list_transform(range(1, len({b}) + 1), lambda j: [j])), lambda new, j: list_append(new, {cell}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_last(list_reduce(list_prepend(list_transform(range(0, len({b}) + 1), lambda z: 0), {matches}), lambda old, m: {row})) END"


def sq_indel(a: str, b: str) -> str:
    """2 * LCS / (length + length) of two strings; two empty ones are alike."""
    chars = "list_transform(range(1, length({0}) + 1), lambda i: substr({0}, i, 1))"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * ({sq_lcs(chars.format(a), chars.format(b))}) / (length({a}) + length({b})) END"
