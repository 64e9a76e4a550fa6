"""Queries over the question-answering tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import chunking, metrics, spans
from ..session import read_table
from . import base as b
from .base import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# Projection, filter, flatten, regroup.

@query("dataset_counts", sql("""SELECT p.split, count(DISTINCT p.article_id) AS articles, count(DISTINCT p.context_id) AS paragraphs, count(q.id) AS questions
FROM p LEFT JOIN q ON q.context_id = p.context_id GROUP BY p.split"""))
def dataset_counts(spark, d):
    p, q = b.paragraphs(spark, d).select("context_id", "article_id", "split"), b.questions(spark, d).groupBy("context_id").agg(F.count("*").alias("n"))
    return p.join(q, "context_id", "left").groupBy("split").agg(
        F.countDistinct("article_id").alias("articles"), F.count("*").alias("paragraphs"), F.sum(F.coalesce("n", F.lit(0))).alias("questions")
    )


@query("filter_possible", sql("SELECT id, context_id, question FROM q WHERE NOT is_impossible"))
def filter_possible(spark, d):
    return b.questions(spark, d).where(~F.col("is_impossible")).select("id", "context_id", "question")


@query("filter_answerable", sql("SELECT id, context_id, question FROM q WHERE NOT is_impossible AND EXISTS (SELECT 1 FROM a WHERE a.qa_id = q.id AND NOT a.is_plausible)"))
def filter_answerable(spark, d):
    a = b.answers(spark, d).where(~F.col("is_plausible")).select(F.col("qa_id").alias("id"))
    return filter_possible(spark, d).join(a, "id", "left_semi")


@query("filter_verified", """WITH raw AS (SELECT DISTINCT id, context_id, coalesce(is_impossible, true) AS is_impossible FROM qas),
p AS (SELECT DISTINCT context_id, context FROM paragraphs), a AS (SELECT DISTINCT answer_id, qa_id, answer_no, coalesce(is_plausible, false) AS is_plausible, text FROM answers),
f AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY answer_no, answer_id) AS rn FROM a WHERE NOT is_plausible)
SELECT raw.id, raw.context_id, f.text FROM raw JOIN p ON p.context_id = raw.context_id JOIN f ON f.qa_id = raw.id AND f.rn = 1
WHERE NOT raw.is_impossible AND f.text <> '' AND contains(p.context, f.text)""")
def filter_verified(spark, d):
    q = read_table(spark, d, "qas", "id", "context_id", "is_impossible").dropDuplicates(["id"])
    first = Window.partitionBy("qa_id").orderBy("answer_no", "answer_id")
    f = b.answers(spark, d).where(~F.col("is_plausible")).withColumn("rn", F.row_number().over(first)).where("rn = 1 and text <> ''")
    p = b.paragraphs(spark, d).select("context_id", "context")
    kept = q.where(~F.coalesce("is_impossible", F.lit(True))).join(f.select(F.col("qa_id").alias("id"), "text"), "id").join(p, "context_id")
    return kept.where(F.contains("context", "text")).select("id", "context_id", "text")


@query("script_filter", sql("SELECT context_id FROM p WHERE regexp_matches(context, '[\\x{c00}-\\x{c7f}]')"))
def script_filter(spark, d):
    return b.paragraphs(spark, d).where(tx.has_script(F.col("context"))).select("context_id")


@query("without_answers", sql("SELECT id, is_impossible FROM q WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.qa_id = q.id AND NOT a.is_plausible)"))
def without_answers(spark, d):
    a = b.answers(spark, d).where(~F.col("is_plausible")).select(F.col("qa_id").alias("id"))
    return b.questions(spark, d).join(a, "id", "left_anti").select("id", "is_impossible")


@query("derived_flag", sql("""SELECT id, coalesce(first_text, '') = '' AS derived_impossible, CASE WHEN coalesce(first_text, '') = '' THEN '' ELSE first_text END AS text,
CASE WHEN coalesce(first_text, '') = '' THEN NULL ELSE first_start END AS answer_start FROM ex WHERE has_answer = 1"""))
def derived_flag(spark, d):
    e = b.examples(spark, d).where("has_answer = 1")
    empty = F.coalesce("first_text", F.lit("")) == ""
    return e.select("id", empty.alias("derived_impossible"), F.when(empty, "").otherwise(F.col("first_text")).alias("text"), F.when(~empty, F.col("first_start")).alias("answer_start"))


@query("context_ids", sql("SELECT context_id, format('c_{:03d}', row_number() OVER (ORDER BY article_id, para_no, context_id)) AS running_id FROM p"))
def context_ids(spark, d):
    """Running ids in document order, without gathering all rows in one task: the counts of the
    articles before give each article's offset (one small row an article is windowed)."""
    p = b.paragraphs(spark, d).select("context_id", "article_id", "para_no")
    per = p.groupBy("article_id").agg(F.count("*").alias("n"))
    # Articles in blocks of 1000, so that no window holds more than a block or the block totals.
    per = per.withColumn("block", F.floor(F.col("article_id") / 1000))
    blocks = per.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("article_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.withColumn("off", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select("article_id", (F.col("off") + F.col("base")).alias("off"))
    # Within an article by range of para_no, then by rank in the range: a large article is spread.
    part = p.withColumn("bin", F.floor(F.col("para_no") / 100))
    bins = part.groupBy("article_id", "bin").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("article_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("article_id", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bin_off"))
    rank = F.row_number().over(Window.partitionBy("article_id", "bin").orderBy("para_no", "context_id"))
    return part.withColumn("rank", rank).join(bins, ["article_id", "bin"]).join(offset, "article_id").select(
        "context_id", F.format_string("c_%03d", F.col("rank") + F.col("bin_off") + F.col("off")).alias("running_id")
    )


@query("first_answers", sql("SELECT id, first_text, first_start, has_answer FROM ex"))
def first_answers(spark, d):
    return b.examples(spark, d).select("id", "first_text", "first_start", "has_answer")


@query("snippets", sql("SELECT answer_id, substr(context, greatest(answer_start - 50, 0) + 1, least(answer_start + length(text) + 50, length(context)) - greatest(answer_start - 50, 0)) AS snippet FROM spans WHERE answer_start BETWEEN 0 AND length(context) AND text IS NOT NULL"))
def snippets(spark, d):
    s = b.spans(spark, d).where("answer_start between 0 and length(context) and text is not null")
    return s.select("answer_id", tx.snippet(F.col("context"), F.col("answer_start"), F.length("text"), 50).alias("snippet"))


@query("regrouped", sql("""SELECT article_id, block, count(*) AS n_paragraphs, string_agg(context_id || ':' || n, ',' ORDER BY para_no, context_id) AS layout FROM (
SELECT p.article_id, p.para_no // 100 AS block, p.para_no, p.context_id, count(q.id) AS n FROM p LEFT JOIN q ON q.context_id = p.context_id GROUP BY ALL) GROUP BY article_id, block"""))
def regrouped(spark, d):
    """Articles in blocks of paragraphs, so that a large article is not gathered in one row."""
    n = b.questions(spark, d).groupBy("context_id").agg(F.count("*").alias("n"))
    p = b.paragraphs(spark, d).select("article_id", F.floor(F.col("para_no") / 100).alias("block"), "para_no", "context_id").join(n, "context_id", "left")
    item = F.struct("para_no", "context_id", F.concat("context_id", F.lit(":"), F.coalesce("n", F.lit(0)).cast("string")).alias("x"))
    return p.groupBy("article_id", "block").agg(F.count("*").alias("n_paragraphs"), F.array_sort(F.collect_list(item)).alias("l")).select(
        "article_id", "block", "n_paragraphs", F.array_join(F.transform("l", lambda x: x["x"]), ",").alias("layout")
    )


@query("dedup_group", sql("SELECT coalesce(title, '') AS title, md5(context) AS context_hash, count(*) AS copies, min(context_id) AS first_id FROM p GROUP BY coalesce(title, ''), context"))
def dedup_group(spark, d):
    p = b.paragraphs(spark, d).select(F.coalesce("title", F.lit("")).alias("title"), "context_id", F.md5("context").alias("context_hash"))
    return p.groupBy("title", "context_hash").agg(F.count("*").alias("copies"), F.min("context_id").alias("first_id"))


@query("stratified_sample", sql("SELECT article_id, id FROM (SELECT article_id, id, row_number() OVER (PARTITION BY article_id ORDER BY md5(id), id) AS rn FROM q) WHERE rn = 1"))
def stratified_sample(spark, d):
    """One question for each article; min of a hash, so a large article needs no window."""
    return b.questions(spark, d).groupBy("article_id").agg(F.min(F.struct(F.md5("id"), F.col("id"))).alias("m")).select("article_id", "m.id")


@query("resume_remaining", sql("SELECT id FROM q WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.qa_id = q.id)"))
def resume_remaining(spark, d):
    from ..streaming.resume import remaining

    return remaining(b.questions(spark, d).select("id"), b.answers(spark, d).select(F.col("qa_id").alias("id")))


# Text functions.

def _texts(name: str, spark_expr, sql_expr: str, where: str = "text IS NOT NULL"):
    @query(name, sql(f"SELECT answer_id, {sql_expr} AS out FROM a WHERE {where}"))
    def run(spark, d):
        return b.answers(spark, d).where(where).select("answer_id", spark_expr(F.col("text")).alias("out"))


_texts("normalize_squeeze", tx.squeeze, b.sq_squeeze("text"))
_texts("normalize_lower", tx.squeeze_lower, f"lower({b.sq_squeeze('text')})")
_texts("normalize_train", tx.normalize_punctuation_first, b.sq_punctuation_first("text"))
_texts("normalize_eval", tx.normalize_articles_first, b.sq_articles_first("text"))
_texts("normalize_script", tx.normalize_script, b.sq_script("text"))
_texts("clean_prediction", tx.clean_prediction, b.sq_squeeze("text"))
_texts("clean_line_feeds", lambda x: tx.clean_prediction(x, collapse=False), f"replace(regexp_replace(text, '^{tx.WS}+|{tx.WS}+$', '', 'g'), chr(10), ' ')")
_texts("strip_endings", tx.strip_ending, "regexp_replace(text, '(లో|కు|తో|యందు)$', '')")
_texts("token_counts", lambda x: F.size(tx.tokens(x)).cast("long"), f"len({b.sq_tokens('text')})")
_texts("char_codes", lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.ascii(F.substring(x, i, F.lit(1))).cast("string")), " "),
       "array_to_string(list_transform(range(1, 13), lambda i: CAST(CASE WHEN substr(text, i, 1) = '' THEN 0 ELSE ord(substr(text, i, 1)) END AS VARCHAR)), ' ')")


_OCC = """occ(answer_id, context, text, pos) AS (SELECT answer_id, context, text, strpos(context, text) - 1 FROM spans WHERE length(text) > 0 AND strpos(context, text) > 0
UNION ALL SELECT answer_id, context, text, pos + strpos(substr(context, pos + 2), text) FROM occ WHERE strpos(substr(context, pos + 2), text) > 0)"""


def _recursive(body: str, *more: str) -> str:
    return sql(body, *more).replace("WITH ", "WITH RECURSIVE ", 1)


@query("find_all", _recursive("SELECT s.answer_id, count(o.pos) AS n, coalesce(min(o.pos), -1) AS first_at, coalesce(max(o.pos), -1) AS last_at FROM spans s LEFT JOIN occ o USING (answer_id) GROUP BY s.answer_id", _OCC))
def find_all(spark, d):
    l = tx.find_all(F.col("context"), F.col("text"))
    s = b.spans(spark, d).select("answer_id", l.alias("l"))
    return s.select("answer_id", F.size("l").cast("long").alias("n"), F.coalesce(F.get("l", F.lit(0)), F.lit(-1)).cast("long").alias("first_at"),
                    F.coalesce(F.get("l", F.size("l") - 1), F.lit(-1)).cast("long").alias("last_at"))


@query("word_boundaries", sql("""SELECT answer_id, CASE WHEN strpos(substr(context, answer_start + 1), ' ') > 0 THEN answer_start + strpos(substr(context, answer_start + 1), ' ') - 1 ELSE length(context) END AS next_blank,
CASE WHEN strpos(reverse(substr(context, 1, answer_start)), ' ') > 0 THEN answer_start - strpos(reverse(substr(context, 1, answer_start)), ' ') + 1 ELSE 0 END AS word_start
FROM spans WHERE answer_start BETWEEN 0 AND length(context)"""))
def word_boundaries(spark, d):
    s, at = b.spans(spark, d).where("answer_start between 0 and length(context)"), F.col("answer_start")
    return s.select("answer_id", tx.word_boundary(F.col("context"), at, True).cast("long").alias("next_blank"), tx.word_boundary(F.col("context"), at, False).cast("long").alias("word_start"))


@query("char_boundaries", sql("""SELECT answer_id, answer_start <= 0 OR answer_start >= length(context) OR ord(substr(context, answer_start + 1, 1)) < 3072 OR ord(substr(context, answer_start, 1)) < 3072 AS ok
FROM spans WHERE answer_start IS NOT NULL"""))
def char_boundaries(spark, d):
    return b.spans(spark, d).where("answer_start is not null").select("answer_id", tx.char_boundary_ok(F.col("context"), F.col("answer_start")).alias("ok"))


# Spans.

_EXACT = """CASE WHEN text IS NULL OR answer_start IS NULL THEN 'missing' WHEN answer_start < 0 OR answer_start >= length(context) THEN 'out of bounds'
WHEN answer_start + length(text) > length(context) THEN 'beyond end' WHEN substr(context, answer_start + 1, length(text)) = text THEN 'ok'
WHEN strpos(context, text) > 0 THEN 'found at ' || (strpos(context, text) - 1) ELSE 'not found' END"""


@query("span_validate_exact", sql(f"SELECT answer_id, {_EXACT} AS verdict FROM spans"))
def span_validate_exact(spark, d):
    return b.spans(spark, d).select("answer_id", spans.exact_verdict(F.col("context"), F.col("text"), F.col("answer_start")).alias("verdict"))


@query("span_validate_summary", sql(f"""SELECT split, count(*) AS total, count(*) FILTER (WHERE v = 'ok') AS valid, count(*) FILTER (WHERE v LIKE 'found at%') AS moved,
round(count(*) FILTER (WHERE v = 'ok') / count(*), 6) AS rate FROM (SELECT split, {_EXACT} AS v FROM spans) GROUP BY split"""))
def span_validate_summary(spark, d):
    v = spans.exact_verdict(F.col("context"), F.col("text"), F.col("answer_start"))
    s = b.spans(spark, d).select("split", v.alias("v"))
    return s.groupBy("split").agg(F.count("*").alias("total"), F.count_if(F.col("v") == "ok").alias("valid"), F.count_if(F.col("v").startswith("found at")).alias("moved")).withColumn(
        "rate", F.round(F.col("valid") / F.col("total"), 6))


def _fuzzy(spark, d):
    return spans.with_fuzzy_valid(b.spans(spark, d), "context", "text", "answer_start")


@query("span_validate_fuzzy")
def span_validate_fuzzy(spark, d):
    return _fuzzy(spark, d).select("answer_id", "valid")


@query("validity_classes")
def validity_classes(spark, d):
    """Valid and invalid, answerable and impossible questions per split, with their shares."""
    v = spans.question_verdicts(_fuzzy(spark, d)).select(F.col("qa_id").alias("id"), "valid")
    q = b.questions(spark, d).join(v, "id", "left").select("split", "is_impossible", F.coalesce("valid", F.lit(False)).alias("valid"))
    n = q.groupBy("split", "is_impossible", "valid").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("invalid_examples")
def invalid_examples(spark, d):
    """Two questions of each kind whose answers are all invalid, with what stands at the place."""
    f = _fuzzy(spark, d).where(F.col("is_plausible") == F.col("is_impossible"))
    bad = f.groupBy("qa_id", "is_impossible").agg(
        F.max(F.col("valid").cast("int")).alias("v"),
        F.min(F.struct("answer_no", "answer_id", "text", F.substring("context", F.col("answer_start") + 1, F.length("text")).alias("stands"))).alias("a"),
    ).where("v = 0")
    part = Window.partitionBy("is_impossible", F.pmod(F.xxhash64("qa_id"), F.lit(64))).orderBy("qa_id")
    few = bad.withColumn("k", F.row_number().over(part)).where("k <= 2")
    return few.withColumn("k", F.row_number().over(Window.partitionBy("is_impossible").orderBy("qa_id"))).where("k <= 2").select(
        "qa_id", "is_impossible", F.col("a.text").alias("text"), F.col("a.stands").alias("stands"))


@query("file_validity", sql("""SELECT split, count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE is_impossible) AS impossible FROM (
SELECT ex.split, ex.is_impossible, ex.is_impossible OR coalesce(first_start >= 0 AND first_start + length(first_text) <= length(context) AND substr(context, first_start + 1, length(first_text)) = first_text, false) AS ok FROM ex) GROUP BY split"""))
def file_validity(spark, d):
    """Questions whose first answer stands at its place; impossible ones count as valid."""
    e = b.examples(spark, d)
    ok = F.col("is_impossible") | F.coalesce(spans.exact_verdict(F.col("context"), F.col("first_text"), F.col("first_start")) == "ok", F.lit(False))
    return e.groupBy("split").agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if("is_impossible").alias("impossible"))


@query("diagnosed_answers", _recursive(f"SELECT s.answer_id, s.verdict, s.snippet, count(o.pos) AS n_places, string_agg(o.pos, ',' ORDER BY o.pos) AS places FROM (SELECT answer_id, {_EXACT} AS verdict, "
       "substr(context, greatest(answer_start - 50, 0) + 1, greatest(least(answer_start + length(text) + 50, length(context)) - greatest(answer_start - 50, 0), 0)) AS snippet FROM spans WHERE NOT is_impossible) s LEFT JOIN occ o ON o.answer_id = s.answer_id AND s.verdict <> 'ok' GROUP BY ALL", _OCC))
def diagnosed_answers(spark, d):
    """Every answer's verdict and surroundings and, if it is not in its place, all places where it stands."""
    s = b.spans(spark, d).where("not is_impossible")
    return spans.diagnosed(s, "context", "text", "answer_start").select("answer_id", "verdict", "snippet", "n_places", "places")


@query("realigned_spans")
def realigned_spans(spark, d):
    """Answers of translated passages, placed again: their offsets were kept from the original."""
    p = b.paragraphs(spark, d).where("orig_context_id is not null").select("context_id")
    s = b.spans(spark, d).join(p, "context_id", "left_semi").where("text is not null and trim(text) <> ''")
    return spans.realigned(s.select("answer_id", "context", "text"), "context", "text").drop("context", "text")


@query("by_occurrence", _recursive("""SELECT answer_id, coalesce(l[r + 1], l[len(l)]) AS new_start FROM (SELECT t.answer_id, o.r, (SELECT list(occ.pos ORDER BY occ.pos) FROM occ WHERE occ.answer_id = t.answer_id) AS l
FROM spans t JOIN p ON p.context_id = t.context_id JOIN o ON o.orig = p.orig_context_id AND o.answer_start = t.answer_start WHERE t.text <> '' AND t.answer_start >= 0)""", _OCC,
    """so AS (SELECT context_id AS orig, answer_start, min({'t': text, 'a': answer_id}) AS m FROM spans WHERE text <> '' AND answer_start >= 0 AND substr(context, answer_start + 1, length(text)) = text GROUP BY ALL),
o AS (SELECT orig, answer_start, (SELECT count(*) FROM occ WHERE occ.answer_id = m.a AND occ.pos < so.answer_start) AS r FROM so)"""))
def by_occurrence(spark, d):
    """Answers of translations, at the occurrence whose rank the original's answer has.

    Translated rows keep the offset of the original, so an original's answer at the same offset
    of the paragraph that they were made from is the one they translate.
    """
    p = b.paragraphs(spark, d)
    made = p.where("orig_context_id is not null").select("context_id", "orig_context_id")
    s = b.spans(spark, d).select("answer_id", "context_id", "context", "text", "answer_start").where("text <> '' and answer_start >= 0")
    o = s.select(F.col("context_id").alias("orig_context_id"), "answer_start", F.col("context").alias("source"), F.col("text").alias("source_text"))
    o = o.where(F.substring("source", F.col("answer_start") + 1, F.length("source_text")) == F.col("source_text"))
    o = o.groupBy("orig_context_id", "answer_start").agg(F.min(F.struct("source_text", "source")).alias("o"))
    j = s.join(made, "context_id").join(o, ["orig_context_id", "answer_start"])
    new = spans.by_occurrence(F.col("o.source"), F.col("o.source_text"), F.col("answer_start"), F.col("context"), F.col("text"))
    return j.select("answer_id", new.alias("new_start"))


# Windows and placing.

def _subs(spark, d):
    return chunking.split_contexts(b.paragraphs(spark, d).select("context_id", "context"), "context_id", "context")


_CHUNKS = """chunks(context_id, context, pos, stop, idx) AS (
SELECT context_id, context, 0, CASE WHEN length(context) <= 500 OR strpos(substr(context, 501), ' ') = 0 THEN length(context) ELSE 499 + strpos(substr(context, 501), ' ') END, 1 FROM p WHERE context IS NOT NULL
UNION ALL SELECT context_id, context, nxt, CASE WHEN nxt + 500 >= length(context) OR strpos(substr(context, nxt + 501), ' ') = 0 THEN length(context) ELSE nxt + 499 + strpos(substr(context, nxt + 501), ' ') END, idx + 1 FROM (
SELECT *, CASE WHEN back > pos AND back < stop THEN back ELSE stop END AS nxt FROM (
SELECT *, CASE WHEN strpos(reverse(substr(context, 1, stop - 100)), ' ') > 0 THEN stop - 100 - strpos(reverse(substr(context, 1, stop - 100)), ' ') + 1 ELSE 0 END AS back FROM chunks WHERE stop < length(context))))"""


@query("split_contexts", _recursive("SELECT context_id, idx AS sub_idx, context_id || format('_{:02d}', idx) AS sub_id, pos AS start_idx, stop - pos AS len FROM chunks", _CHUNKS))
def split_contexts(spark, d):
    return _subs(spark, d).select("context_id", "sub_idx", "sub_id", "start_idx", F.length("text").alias("len"))


@query("split_statistics", _recursive("SELECT count(*) AS chunks, count(DISTINCT context_id) AS contexts, round(count(*) / count(DISTINCT context_id), 6) AS average FROM chunks", _CHUNKS))
def split_statistics(spark, d):
    per = _subs(spark, d).groupBy("context_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("chunks"), F.count("*").alias("contexts")).withColumn("average", F.round(F.col("chunks") / F.col("contexts"), 6))


def _first(spark, d):
    return b.examples(spark, d).select("id", "context_id", "is_impossible", F.col("first_text").alias("answer_text"), F.col("first_start").alias("answer_start"))


_PLACED = [_CHUNKS, """qq AS (SELECT id, context_id, is_impossible, first_text AS t, first_start AS a FROM ex WHERE is_impossible OR (first_text IS NOT NULL AND first_start IS NOT NULL)),
sb AS (SELECT context_id, idx, context_id || format('_{:02d}', idx) AS sub_id, pos, substr(context, pos + 1, stop - pos) AS txt FROM chunks),
nr AS (SELECT id, (min({'d': abs(a - pos), 'i': idx})).i AS near FROM qq JOIN sb USING (context_id) GROUP BY id),
rk AS (SELECT qq.id, qq.context_id, is_impossible, idx, sub_id, strpos(txt, t) AS hit, CASE WHEN idx = near THEN 0 WHEN idx = near + 1 THEN 1 WHEN idx = near - 1 THEN 2 ELSE 3 END AS r
  FROM qq JOIN sb USING (context_id) JOIN nr ON nr.id = qq.id),
pl AS (SELECT id, context_id, is_impossible, min({'r': r, 'i': idx, 's': sub_id, 'h': hit - 1}) FILTER (WHERE CASE WHEN is_impossible THEN idx = 1 ELSE hit > 0 END) AS m FROM rk GROUP BY id, context_id, is_impossible)"""]


@query("place_answers", _recursive("SELECT id, context_id, is_impossible, m.s AS sub_id, CASE WHEN NOT is_impossible THEN m.h END AS answer_start FROM pl WHERE m IS NOT NULL", *_PLACED))
def place_answers(spark, d):
    return chunking.place_answers(_first(spark, d), b.paragraphs(spark, d).select("context_id", "context")).where("sub_id is not null")


@query("lost_answers", _recursive("SELECT id, context_id FROM pl WHERE m IS NULL", *_PLACED))
def lost_answers(spark, d):
    return chunking.place_answers(_first(spark, d), b.paragraphs(spark, d).select("context_id", "context")).where("sub_id is null").select("id", "context_id")


# Scores.

@query("qa_em_f1", sql(f"SELECT id, model, {b.sq_em()} AS em, round({b.sq_f1()}, 6) AS f1 FROM sc"))
def qa_em_f1(spark, d):
    return b.scored(spark, d).select("id", "model", metrics.exact_match(F.col("pred"), F.col("gold")).alias("em"), F.round(metrics.f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


def _sq_norm_em(norm) -> str:
    return f"CAST({norm('pred')} = {norm('gold')} AS DOUBLE)"


@query("em_by_normalizer", sql(f"SELECT model, round(100 * avg({_sq_norm_em(b.sq_punctuation_first)}), 4) AS em_train, round(100 * avg({_sq_norm_em(b.sq_articles_first)}), 4) AS em_eval, round(100 * avg({b.sq_em()}), 4) AS em_script FROM sc GROUP BY model"))
def em_by_normalizer(spark, d):
    p, g = F.col("pred"), F.col("gold")
    return b.scored(spark, d).groupBy("model").agg(*(F.round(100 * F.avg(metrics.exact_match(p, g, n)), 4).alias(f"em_{k}") for k, n in tx.NORMALIZERS.items()))


def _means():
    p, g = F.col("pred"), F.col("gold")
    return [F.round(100 * F.avg(metrics.exact_match(p, g)), 4).alias("em"), F.round(100 * F.avg(metrics.f1(p, g)), 4).alias("f1"), F.round(metrics.impossible_accuracy(p, g), 4).alias("impossible_acc")]


_SQ_MEANS = f"round(100 * avg({b.sq_em()}), 4) AS em, round(100 * avg({b.sq_f1()}), 4) AS f1, round(coalesce(100.0 * count(*) FILTER (WHERE {b.sq_blank('gold')} AND {b.sq_blank('pred')}) / nullif(count(*) FILTER (WHERE {b.sq_blank('gold')}), 0), 100), 4) AS impossible_acc"


@query("qa_metrics_mean", sql(f"SELECT model, split, {_SQ_MEANS} FROM sc GROUP BY model, split"))
def qa_metrics_mean(spark, d):
    return b.scored(spark, d).groupBy("model", "split").agg(*_means())


@query("qa_metrics_rollup", sql(f"SELECT coalesce(model, 'all') AS model, coalesce(split, 'all') AS split, {_SQ_MEANS} FROM sc GROUP BY ROLLUP (model, split)"))
def qa_metrics_rollup(spark, d):
    return b.scored(spark, d).rollup("model", "split").agg(*_means()).withColumns({c: F.coalesce(c, F.lit("all")) for c in ("model", "split")})


@query("compare_models", sql(f"""SELECT split, max(em) FILTER (WHERE model = 'slice') AS slice_em, max(em) FILTER (WHERE model = 'last') AS last_em, max(f1) FILTER (WHERE model = 'slice') AS slice_f1, max(f1) FILTER (WHERE model = 'last') AS last_f1
FROM (SELECT model, split, {_SQ_MEANS} FROM sc GROUP BY model, split) GROUP BY split"""))
def compare_models(spark, d):
    m = qa_metrics_mean(spark, d)
    return m.groupBy("split").pivot("model", ["slice", "last"]).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


@query("impossible_accuracy", sql(f"SELECT model, {_SQ_MEANS[_SQ_MEANS.index('round(coalesce'):]} FROM sc GROUP BY model"))
def impossible_accuracy(spark, d):
    return b.scored(spark, d).groupBy("model").agg(_means()[-1])


@query("error_taxonomy", sql(f"SELECT id, model, {b.sq_error()} AS error_type FROM sc"))
def error_taxonomy(spark, d):
    return b.scored(spark, d).select("id", "model", metrics.error_type(F.col("pred"), F.col("gold")).alias("error_type"))


@query("error_counts", sql(f"SELECT model, error_type, count(*) AS n FROM (SELECT model, {b.sq_error()} AS error_type FROM sc) GROUP BY ALL"))
def error_counts(spark, d):
    return error_taxonomy(spark, d).groupBy("model", "error_type").agg(F.count("*").alias("n"))


@query("misclassified_top", sql(f"SELECT model, id, error_type FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) AS rn FROM (SELECT model, id, {b.sq_error()} AS error_type FROM sc) WHERE error_type <> 'Correct') WHERE rn <= 5"))
def misclassified_top(spark, d):
    """The first five of each model by id (a top-k report; partial top-k first, no full sort)."""
    e = error_taxonomy(spark, d).where("error_type <> 'Correct'")
    part = Window.partitionBy("model", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = e.withColumn("rn", F.row_number().over(part)).where("rn <= 5")
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("model").orderBy("id"))).where("rn <= 5").select("model", "id", "error_type")


_SQ_CONFUSION = f"count(*) FILTER (WHERE NOT {b.sq_blank('gold')} AND NOT {b.sq_blank('pred')}) AS tp, count(*) FILTER (WHERE {b.sq_blank('gold')} AND NOT {b.sq_blank('pred')}) AS fp, count(*) FILTER (WHERE NOT {b.sq_blank('gold')} AND {b.sq_blank('pred')}) AS fn, count(*) FILTER (WHERE {b.sq_blank('gold')} AND {b.sq_blank('pred')}) AS tn"


@query("confusion_matrix", sql(f"SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT model, {_SQ_CONFUSION} FROM sc GROUP BY model)"))
def confusion_matrix(spark, d):
    return metrics.derived(b.scored(spark, d).groupBy("model").agg(*metrics.confusion(F.col("pred"), F.col("gold"))))


@query("answer_length_hist", sql(f"SELECT CAST(least(floor(n / 2), 13) * 2 AS BIGINT) AS bin_start, count(*) AS n FROM (SELECT len({b.sq_tokens('text')}) AS n FROM a WHERE text IS NOT NULL) WHERE n BETWEEN 0 AND 28 GROUP BY 1"))
def answer_length_hist(spark, d):
    a = b.answers(spark, d).where("text is not null").select(F.size(tx.tokens(F.col("text"))).alias("words"))
    return metrics.histogram(a, "words")


@query("length_against_f1", sql(f"SELECT id, len({b.sq_tokens('question')}) AS q_len, len({b.sq_tokens('context')}) AS c_len, round({b.sq_f1()}, 6) AS f1 FROM sc WHERE model = 'last'"))
def length_against_f1(spark, d):
    s = b.scored(spark, d).where("model = 'last'")
    return s.select("id", F.size(tx.tokens(F.col("question"))).cast("long").alias("q_len"), F.size(tx.tokens(F.col("context"))).cast("long").alias("c_len"), F.round(metrics.f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


@query("error_analysis", sql(f"SELECT id, model, gold AS gold_text, pred AS pred_text, {b.sq_em()} AS em, round({b.sq_f1()}, 6) AS f1, {b.sq_error()} AS error_type, len({b.sq_tokens('gold')}) AS gold_len, len({b.sq_tokens('pred')}) AS pred_len FROM sc"))
def error_analysis(spark, d):
    p, g = F.col("pred"), F.col("gold")
    return b.scored(spark, d).select("id", "model", g.alias("gold_text"), p.alias("pred_text"), metrics.exact_match(p, g).alias("em"), F.round(metrics.f1(p, g), 6).alias("f1"),
                                     metrics.error_type(p, g).alias("error_type"), F.size(tx.tokens(g)).cast("long").alias("gold_len"), F.size(tx.tokens(p)).cast("long").alias("pred_len"))


# BLEU and ROUGE, on normalized tokens.

_SQ_P, _SQ_G = b.sq_tokens(b.sq_script("pred")), b.sq_tokens(b.sq_script("gold"))


def _sq_counts(n: int) -> str:
    cols = ["p_tok", "g_tok", "id", "model", "split"]
    for k in range(1, n + 1):
        cols.append(f"{b.sq_clipped(b.sq_ngrams('p_tok', k), b.sq_ngrams('g_tok', k))} AS hit{k}, greatest(len(p_tok) - {k - 1}, 0) AS all{k}")
    return f"bl AS (SELECT {', '.join(cols)} FROM (SELECT id, model, split, {_SQ_P} AS p_tok, {_SQ_G} AS g_tok FROM sc))"


def _sq_bleu(order: int) -> str:
    w = metrics.BLEU_WEIGHTS[order]
    logs = " + ".join(f"{x} * ln((CASE WHEN hit{k} > 0 THEN hit{k} ELSE 0.1 END) / greatest(all{k}, 1))" for k, x in enumerate(w, 1))
    return (f"CASE WHEN hit1 = 0 OR len(p_tok) = 0 OR len(g_tok) = 0 THEN 0.0 ELSE exp((CASE WHEN len(p_tok) > len(g_tok) THEN 0.0 ELSE 1.0 - len(g_tok) / greatest(len(p_tok), 1) END) + {logs}) END")


@query("bleu", sql("SELECT id, model, " + ", ".join(f"round({_sq_bleu(k)}, 6) AS bleu{k}" for k in range(1, 5)) + " FROM bl", _sq_counts(4)))
def bleu(spark, d):
    parts = metrics.bleu_parts(tx.normalize_script(F.col("pred")), tx.normalize_script(F.col("gold")), 4)
    s = b.scored(spark, d).select("id", "model", *(c.alias(k) for k, c in parts.items()))
    cols = {k: F.col(k) for k in parts}
    return s.select("id", "model", *(F.round(metrics.bleu_from(cols, k), 6).alias(f"bleu{k}") for k in range(1, 5)))


@query("corpus_bleu", sql("""SELECT model, round(CASE WHEN h1 = 0 OR h2 = 0 OR h3 = 0 OR h4 = 0 THEN 0.0 ELSE exp((CASE WHEN pl > gl THEN 0.0 ELSE 1.0 - gl / greatest(pl, 1) END)
+ 0.25 * (ln(h1 / greatest(a1, 1)) + ln(h2 / greatest(a2, 1)) + ln(h3 / greatest(a3, 1)) + ln(h4 / greatest(a4, 1)))) END, 6) AS bleu FROM (SELECT model, sum(len(p_tok)) AS pl, sum(len(g_tok)) AS gl,
sum(hit1) AS h1, sum(hit2) AS h2, sum(hit3) AS h3, sum(hit4) AS h4, sum(all1) AS a1, sum(all2) AS a2, sum(all3) AS a3, sum(all4) AS a4 FROM bl GROUP BY model)""", _sq_counts(4)))
def corpus_bleu(spark, d):
    parts = metrics.bleu_parts(tx.normalize_script(F.col("pred")), tx.normalize_script(F.col("gold")), 4)
    s = b.scored(spark, d).groupBy("model").agg(*(F.sum(c).alias(k) for k, c in parts.items()))
    return s.select("model", F.round(metrics.bleu_from({k: F.col(k) for k in parts}, 4, smooth=False), 6).alias("bleu"))


_SQ_RT = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: t <> '')"


def _sq_rouge_of(n: int) -> str:
    hit = b.sq_clipped(b.sq_ngrams("p_tok", n), b.sq_ngrams("g_tok", n))
    return f"CASE WHEN {hit} = 0 THEN 0.0 ELSE 2.0 * {hit} / (len(p_tok) + len(g_tok) - {2 * (n - 1)}) END"


def _sq_rouge(n: int) -> str:
    return f"round({_sq_rouge_of(n)}, 6) AS rouge{n}"


@query("rouge_n", sql(f"SELECT id, model, {_sq_rouge(1)}, {_sq_rouge(2)} FROM (SELECT id, model, {_SQ_RT.format('pred')} AS p_tok, {_SQ_RT.format('gold')} AS g_tok FROM sc)"))
def rouge_n(spark, d):
    s = b.scored(spark, d).select("id", "model", *(c.alias(f"rouge{n}") for n, c in enumerate(metrics.rouge_n(F.col("pred"), F.col("gold"), 2, unicode=True), 1)))
    return s.withColumns({c: F.round(c, 6) for c in ("rouge1", "rouge2")})


_SQ_ROUGE_TOKENS = f"rt AS (SELECT id, model, split, {_SQ_RT.format('pred')} AS p_tok, {_SQ_RT.format('gold')} AS g_tok FROM sc)"
_SQ_ROUGE_L = f"CASE WHEN len(p_tok) + len(g_tok) = 0 THEN 0.0 ELSE 2.0 * ({b.sq_lcs('p_tok', 'g_tok')}) / (len(p_tok) + len(g_tok)) END"


@query("rouge_l", sql(f"SELECT id, model, round({_SQ_ROUGE_L}, 6) AS rouge_l FROM rt", _SQ_ROUGE_TOKENS))
def rouge_l(spark, d):
    return b.scored(spark, d).select("id", "model", F.round(metrics.rouge_l(F.col("pred"), F.col("gold"), unicode=True), 6).alias("rouge_l"))


@query("rouge_stemmed")
def rouge_stemmed(spark, d):
    """ROUGE 1, 2 and L on ASCII words with stems."""
    p, g = F.col("pred"), F.col("gold")
    r1, r2 = metrics.rouge_n(p, g, 2, stem=True)
    s = b.scored(spark, d).select("id", "model", r1.alias("rouge1"), r2.alias("rouge2"), metrics.rouge_l(p, g, stem=True).alias("rouge_l"))
    return s.withColumns({c: F.round(c, 6) for c in ("rouge1", "rouge2", "rouge_l")})


@query("all_metrics", sql(f"""SELECT m.*, bleu1, bleu2, bleu3, bleu4, rouge1, rouge2, rouge_l FROM (SELECT model, split, {_SQ_MEANS} FROM sc GROUP BY model, split) m
JOIN (SELECT model, split, {', '.join(f'round(100 * avg({_sq_bleu(k)}), 4) AS bleu{k}' for k in range(1, 5))} FROM bl GROUP BY model, split) x USING (model, split)
JOIN (SELECT model, split, round(100 * avg({_sq_rouge_of(1)}), 4) AS rouge1, round(100 * avg({_sq_rouge_of(2)}), 4) AS rouge2, round(100 * avg({_SQ_ROUGE_L}), 4) AS rouge_l FROM rt GROUP BY model, split) y USING (model, split)""", _sq_counts(4), _SQ_ROUGE_TOKENS))
def all_metrics(spark, d):
    """Every metric of a model and split in one aggregate over one scan of the predictions."""
    p, g = F.col("pred"), F.col("gold")
    parts = metrics.bleu_parts(tx.normalize_script(p), tx.normalize_script(g), 4)
    r1, r2 = metrics.rouge_n(p, g, 2, unicode=True)
    s = b.scored(spark, d).select("model", "split", "pred", "gold", *(c.alias(k) for k, c in parts.items()), r1.alias("r1"), r2.alias("r2"), metrics.rouge_l(p, g, unicode=True).alias("rl"))
    each = {k: F.col(k) for k in parts}
    return s.groupBy("model", "split").agg(
        *_means(), *(F.round(100 * F.avg(metrics.bleu_from(each, k)), 4).alias(f"bleu{k}") for k in range(1, 5)),
        *(F.round(100 * F.avg(c), 4).alias(n) for c, n in (("r1", "rouge1"), ("r2", "rouge2"), ("rl", "rouge_l"))),
    )


@query("metrics_by_split", sql(f"""SELECT model, metric, max(v) FILTER (WHERE split = 'validation') AS validation, max(v) FILTER (WHERE split = 'test') AS test
FROM (UNPIVOT (SELECT model, split, {_SQ_MEANS} FROM sc GROUP BY model, split) ON em, f1, impossible_acc INTO NAME metric VALUE v) GROUP BY model, metric"""))
def metrics_by_split(spark, d):
    """The summary of validation beside test: one row for each metric."""
    m = qa_metrics_mean(spark, d).unpivot(["model", "split"], ["em", "f1", "impossible_acc"], "metric", "v")
    return m.groupBy("model", "metric").pivot("split", ["validation", "test"]).agg(F.max("v"))


@query("completed_predictions", sql("SELECT q.id, q.question, coalesce(l.text, '') AS pred FROM q LEFT JOIN (SELECT qa_id, max(text) AS text FROM a WHERE NOT is_plausible AND answer_no = 0 GROUP BY qa_id) l ON l.qa_id = q.id"))
def completed_predictions(spark, d):
    """Predictions for all examples: what is missing counts as empty, what is too much is dropped."""
    preds = b.answers(spark, d).where("not is_plausible and answer_no = 0").groupBy(F.col("qa_id").alias("id")).agg(F.max("text").alias("pred"))
    return metrics.complete(b.questions(spark, d).select("id", "question"), preds)


@query("adjusted_dataset")
def adjusted_dataset(spark, d):
    """Translated passages with all answers placed again, as a flat data set."""
    return _adjusted(spark, d)[0].select("id", "is_impossible", F.to_json("answers").alias("answers"), F.to_json("plausible_answers").alias("plausible_answers"))


@query("low_similarity")
def low_similarity(spark, d):
    """The report of answers placed with low similarity, by title."""
    return spans.low_report(_adjusted(spark, d)[1]).select("title", F.size("paragraphs").alias("n_cases"))


def _adjusted(spark, d):
    from .io_queries import flat_dataset

    p = b.paragraphs(spark, d).where("orig_context_id is not null").select("context_id")
    return spans.adjust_dataset(flat_dataset(spark, d).join(p, "context_id", "left_semi"))
