"""Reading and writing nested question-answering files and their flat forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "struct<text:string,answer_start:int>"
SQUAD = (
    "version string, data array<struct<title:string,paragraphs:array<struct<context:string,context_id:string,qas:array<struct<"
    f"id:string,question:string,is_impossible:boolean,answers:array<{ANSWER}>,plausible_answers:array<{ANSWER}>>>>>>>"
)
FLAT = (
    "article_idx int, para_idx int, qa_idx int, title string, context_id string, context string, id string, question string, "
    f"is_impossible boolean, answers array<{ANSWER}>, plausible_answers array<{ANSWER}>"
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Those of ``names`` that ``folder`` does not have."""
    return [n for n in names if not exists(spark, f"{folder.rstrip('/')}/{n}")]


def read_squad(spark: SparkSession, path: str, strict: bool = True, lines: bool = False) -> DataFrame:
    """Nested document(s): whole files, or with ``lines`` one document a line.

    ``strict`` fails on a missing path or a malformed document. Otherwise a missing path gives
    an empty frame, and malformed documents come out with null ``data`` and their text in
    ``_corrupt_record``.
    """
    reader = spark.read.option("multiLine", not lines)
    if strict:
        return reader.schema(SQUAD).option("mode", "FAILFAST").json(path)
    schema = f"{SQUAD}, _corrupt_record string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def flatten(nested: DataFrame, impossible_default: bool = False) -> DataFrame:
    """One row for each question, with the ordinals that keep the order.

    Missing answer arrays become empty; a missing flag becomes ``impossible_default``.
    """
    a = nested.select(F.posexplode("data").alias("article_idx", "a"))
    p = a.select("article_idx", F.col("a.title").alias("title"), F.posexplode("a.paragraphs").alias("para_idx", "p"))
    q = p.select("article_idx", "para_idx", "title", F.col("p.context_id").alias("context_id"), F.col("p.context").alias("context"), F.posexplode("p.qas").alias("qa_idx", "q"))
    none = F.array().cast(f"array<{ANSWER}>")
    return q.select(
        "article_idx", "para_idx", "qa_idx", "title", "context_id", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"),
        F.coalesce("q.is_impossible", F.lit(impossible_default)).alias("is_impossible"),
        F.coalesce("q.answers", none).alias("answers"), F.coalesce("q.plausible_answers", none).alias("plausible_answers"),
    )


def regroup(flat: DataFrame, part: int | None = None) -> DataFrame:
    """Back to one row for each article: (article_idx, part, title, paragraphs); empty parents vanish.

    With ``part`` an article of many paragraphs gives several rows, of at most that many
    paragraphs each, so that no task holds a large article whole.
    """
    qa = F.struct("qa_idx", "id", "question", "is_impossible", "answers", "plausible_answers")
    paras = flat.groupBy("article_idx", "para_idx").agg(
        F.first("title").alias("title"), F.first("context").alias("context"), F.first("context_id").alias("context_id"),
        F.transform(F.array_sort(F.collect_list(qa)), lambda x: x.dropFields("qa_idx")).alias("qas"),
    )
    para = F.struct("para_idx", "context", "context_id", "qas")
    number = F.floor(F.col("para_idx") / part).cast("int") if part else F.lit(0)
    return paras.groupBy("article_idx", number.alias("part")).agg(
        F.first("title").alias("title"), F.transform(F.array_sort(F.collect_list(para)), lambda x: x.dropFields("para_idx")).alias("paragraphs")
    )


def write_squad(flat: DataFrame, path: str, part: int | None = 500, version: str = "v2.0") -> None:
    """Nested documents, one a line: {version, data: [article]}, articles in parts of ``part``
    paragraphs. ``read_squad(path, lines=True)`` reads them; non-ASCII characters are kept."""
    article = F.struct("title", "paragraphs")
    regroup(flat, part).select(F.lit(version).alias("version"), F.array(article).alias("data")).write.mode("overwrite").json(path)


def export_document(flat: DataFrame, path: str, version: str = "v2.0", indent: int = 4, limit: int = 100_000) -> None:
    """One pretty-printed document in one local file, for people to read; at most ``limit`` questions."""
    import json

    n = flat.count()
    if n > limit:
        raise ValueError(f"{n} questions are too many for one file; use write_squad")
    rows = regroup(flat).orderBy("article_idx", "part").select(F.to_json(F.struct("title", "paragraphs"), {"ignoreNullFields": "false"}).alias("j")).collect()
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": version, "data": [json.loads(r["j"]) for r in rows]}, f, ensure_ascii=False, indent=indent)


TYDI = "id string, title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>"


def read_parallel(spark: SparkSession, path: str, keep=None) -> DataFrame:
    """Flat records whose answers are parallel arrays, as a flat data set; ``keep`` filters the
    records (for instance by the script of the question). Nothing in them is impossible."""
    rows = spark.read.schema(TYDI).json(path)
    rows = rows.where(keep) if keep is not None else rows
    return rows.select(
        "title", "context", "id", "question", F.lit(False).alias("is_impossible"),
        zip_answers(F.col("answers.text"), F.col("answers.answer_start")).alias("answers"),
    )


def zip_answers(texts, starts):
    """Parallel arrays to an array of answers, cut to the shorter one."""
    n = F.least(F.size(texts), F.size(starts))
    return F.transform(F.arrays_zip(F.slice(texts, 1, n).alias("text"), F.slice(starts, 1, n).alias("answer_start")), lambda x: F.struct(
        x["text"].alias("text"), x["answer_start"].cast("int").alias("answer_start")))


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet table, or an empty one where the path does not exist."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV report that ``write_report`` made; texts with line breaks and quotes come back unchanged."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)


# Backslashes are no escapes, quotes are doubled; blanks at the ends and empty texts are kept.
_CSV = {"header": True, "escape": '"', "quoteAll": True, "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_report(df: DataFrame, path: str, only_if_any: bool = True, kind: str = "json") -> bool:
    """A side report as JSON or CSV; True if it was written."""
    if only_if_any and df.isEmpty():
        return False
    w = df.write.mode("overwrite")
    w.options(**_CSV).csv(path) if kind == "csv" else w.json(path)
    return True


def log_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Append a run's metrics, with its name and the time, to a table of runs."""
    metrics.withColumns({"run": F.lit(run), "logged_at": F.current_timestamp()}).write.mode("append").parquet(path)


def format_table(df: DataFrame, title: str, rows: int = 50) -> str:
    """A fixed-width table with a title, for the console (the first ``rows`` rows)."""
    shown = [[c for c in df.columns], *([("" if v is None else str(v)) for v in r] for r in df.limit(rows).collect())]
    widths = [max(len(r[i]) for r in shown) for i in range(len(df.columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    lines = ["| " + " | ".join(v.ljust(w) for v, w in zip(r, widths)) + " |" for r in shown]
    return "\n".join([title.center(len(rule)), rule, lines[0], rule, *lines[1:], rule])
