"""Queries over sources and sinks: data sets, reports and features are written, read again and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features, spans
from ..session import work_dir
from ..sources import squad
from ..streaming import resume
from . import base as b
from .base import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def flat_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The tables as a flat data set, in the form of ``squad.flatten``."""
    item = F.struct("answer_no", "answer_id", F.struct("text", "answer_start").alias("a"))
    none = F.array().cast(f"array<{squad.ANSWER}>")

    def side(flag: str, name: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.expr(flag), item))), lambda x: x["a"]).alias(name)

    a = b.answers(spark, d).groupBy(F.col("qa_id").alias("id")).agg(side("not is_plausible", "answers"), side("is_plausible", "plausible_answers"))
    # A title belongs to the article; some of its paragraphs lack it.
    p = b.paragraphs(spark, d).select("context_id", F.col("article_id").cast("int").alias("article_idx"), F.col("para_no").alias("para_idx"), "title", "context")
    p = p.drop("title").join(p.groupBy("article_idx").agg(F.max("title").alias("title")), "article_idx")
    q = b.questions(spark, d).select("id", "context_id", "question", "is_impossible").withColumn("qa_idx", F.xxhash64("id"))
    j = q.join(a, "id", "left").join(p, "context_id")
    return j.select(
        "article_idx", "para_idx", "qa_idx", "title", "context_id", "context", "id", "question", "is_impossible",
        F.coalesce("answers", none).alias("answers"), F.coalesce("plausible_answers", none).alias("plausible_answers"),
    )


_SQ_SIDE = "(SELECT string_agg(coalesce(text, 'null') || '@' || coalesce(answer_start::VARCHAR, 'null'), '|' ORDER BY answer_no, answer_id) FROM a WHERE a.qa_id = q.id AND {0} is_plausible)"


def _shown(c: str):
    return F.nullif(F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x["text"], F.lit("null")), F.lit("@"), F.coalesce(x["answer_start"].cast("string"), F.lit("null")))), "|"), F.lit(""))


@query("nested_documents", sql(f"SELECT q.id, q.context_id, (SELECT max(title) FROM p t WHERE t.article_id = p.article_id) AS title, md5(p.context) AS context_hash, q.question, q.is_impossible, {_SQ_SIDE.format('NOT')} AS answers, {_SQ_SIDE.format('')} AS plausible FROM q JOIN p ON p.context_id = q.context_id"))
def nested_documents(spark, d):
    """The data set regrouped, written as nested documents, read and flattened again."""
    path = _path(spark, "documents")
    squad.write_squad(flat_dataset(spark, d), path)
    f = squad.flatten(squad.read_squad(spark, path, lines=True))
    return f.select("id", "context_id", "title", F.md5("context").alias("context_hash"), "question", "is_impossible", _shown("answers").alias("answers"), _shown("plausible_answers").alias("plausible"))


@query("tolerant_read", sql("SELECT q.split, count(*) AS read, 1 AS broken, 0 AS missing FROM q GROUP BY q.split"))
def tolerant_read(spark, d):
    """Per split: questions read from a folder in which one document is broken, and from a missing path."""
    q = b.questions(spark, d)
    split = q.select("id", "split")
    path = _path(spark, "tolerant")
    squad.write_squad(flat_dataset(spark, d), path)
    spark.range(1).select(F.lit('{"version": "v2.0", "data": [{"title": "cut o').alias("value")).write.mode("append").text(path)
    docs = squad.read_squad(spark, path, strict=False, lines=True)
    broken = docs.where("_corrupt_record is not null and data is null").agg(F.count("*").alias("broken"))
    missing = squad.flatten(squad.read_squad(spark, path + "-none", strict=False)).agg(F.count("*").alias("missing"))
    read = squad.flatten(docs).join(split, "id").groupBy("split").agg(F.count("*").alias("read"))
    # Both are aggregates of one row.
    return read.join(F.broadcast(broken), F.lit(True)).join(F.broadcast(missing), F.lit(True))


@query("parallel_examples", sql("SELECT q.id, q.question, (SELECT string_agg(text || '@' || answer_start, '|' ORDER BY answer_no, answer_id) FROM a WHERE a.qa_id = q.id AND NOT is_plausible AND text IS NOT NULL AND answer_start IS NOT NULL) AS answers FROM q JOIN p ON p.context_id = q.context_id WHERE regexp_matches(q.question, '[\\x{c00}-\\x{c7f}]')"))
def parallel_examples(spark, d):
    """Records with parallel answer arrays, written, read again, and kept by the script of the question."""
    path = _path(spark, "parallel")
    whole = F.filter("answers", lambda x: x["text"].isNotNull() & x["answer_start"].isNotNull())
    f = flat_dataset(spark, d).withColumn("answers", whole)
    f.select("id", "title", "context", "question", F.struct(F.col("answers.text").alias("text"), F.col("answers.answer_start").alias("answer_start")).alias("answers")).write.json(path)
    return squad.read_parallel(spark, path, tx.has_script(F.col("question"))).select("id", "question", _shown("answers").alias("answers"))


@query("contexts_csv", sql("SELECT context_id, md5(context) AS context_hash FROM p"))
def contexts_csv(spark, d):
    """Contexts as CSV and back: line breaks, quotes and backslashes are kept."""
    path = _path(spark, "contexts")
    squad.write_report(b.paragraphs(spark, d).select("context_id", "context"), path, kind="csv")
    return squad.read_csv(spark, path, "context_id string, context string").select("context_id", F.md5("context").alias("context_hash"))


@query("metric_csv", sql("SELECT split, count(*) AS n, round(avg(length(context)), 4) AS mean_length FROM p GROUP BY split"))
def metric_csv(spark, d):
    path = _path(spark, "metric")
    m = b.paragraphs(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.length("context")), 4).alias("mean_length"))
    squad.write_report(m, path, kind="csv")
    return squad.read_csv(spark, path, "split string, n long, mean_length double")


_WRONG = "answer_start IS NOT NULL AND text IS NOT NULL AND substr(context, answer_start + 1, length(text)) <> text AND answer_start >= 0"


@query("invalid_spans", sql(f"SELECT answer_id, text AS answer_text, answer_start AS start_position, substr(context, answer_start + 1, length(text)) AS span_text FROM spans WHERE {_WRONG}"))
def invalid_spans(spark, d):
    """Answers that do not stand at their place, with what stands there, as a CSV report."""
    path = _path(spark, "invalid")
    s = b.spans(spark, d).where(_WRONG.replace("substr", "substring"))
    bad = s.select("answer_id", F.col("text").alias("answer_text"), F.col("answer_start").alias("start_position"), spans.span_at(F.col("context"), F.col("answer_start"), F.length("text")).alias("span_text"))
    squad.write_report(bad, path, kind="csv")
    return squad.read_csv(spark, path, "answer_id long, answer_text string, start_position int, span_text string")


@query("side_report", "SELECT 'filled' AS report, true AS written UNION ALL SELECT 'empty', false")
def side_report(spark, d):
    """A report is written only if it has rows."""
    p = b.paragraphs(spark, d).select("context_id")
    rows = [("filled", squad.write_report(p, _path(spark, "filled"))), ("empty", squad.write_report(p.where("false"), _path(spark, "empty")))]
    return spark.createDataFrame(rows, "report string, written boolean")


@query("saved_features", sql("SELECT split, count(*) AS n_rows FROM ex WHERE split = 'train' GROUP BY split"))
def saved_features(spark, d):
    """Feature rows saved by split; one split is read again (partition pruning)."""
    path = _path(spark, "features")
    e = b.examples(spark, d).sortWithinPartitions("context_id")
    features.save_features(features.build_windows(e, max_length=384, carry=("split",)), path)
    return features.load_features(spark, path, "train").groupBy("split").agg(F.count("*").alias("n_rows"))


@query("optional_split", "SELECT count(*) AS n, 0 AS n_missing FROM (SELECT DISTINCT context_id FROM paragraphs WHERE split = 'test')")
def optional_split(spark, d):
    """A split that has a table, and one that has none."""
    path = _path(spark, "split")
    b.paragraphs(spark, d).where("split = 'test'").select("context_id").write.parquet(path)
    have, lack = (squad.optional_table(spark, x, "context_id string").agg(F.count("*").alias(n)) for x, n in ((path, "n"), (path + "-none", "n_missing")))
    return have.join(F.broadcast(lack), F.lit(True))


@query("processed_once", sql("SELECT id, length(question) AS n FROM q"))
def processed_once(spark, d):
    """Files are processed once, however often the step runs: two runs, the second over one new file."""
    source, sink, check = (_path(spark, x) for x in ("in", "out", "check"))
    q = b.questions(spark, d).select("id", "question")
    first = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for part in (first, ~first):
        q.where(part).coalesce(1).write.mode("append").parquet(source)
        resume.process_new(spark, source, "id string, question string", lambda s: s.select("id", F.length("question").alias("n")), sink, check)
    return spark.read.parquet(sink)
