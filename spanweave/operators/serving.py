"""Answering requests: the batch plan over request rows, and a single request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decode, features

REQUEST = "id string, question string, context string"
# Fixed value: the payload of a request that lacks a side.
REJECTED = "Both question and context are required."


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests (id, question, context) as JSON lines, of a folder or of a stream of files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST).json(path)


def respond(requests: DataFrame, predict: Callable, tokenizer: features.Tokenizer = features.word_tokenizer, max_length: int = 512) -> DataFrame:
    """(id, question, answer, error) for every request (id, question, context).

    Both sides are trimmed; a request without one gets an error and no answer.
    """
    r = requests.select("id", F.trim(F.coalesce("question", F.lit(""))).alias("question"), F.trim(F.coalesce("context", F.lit(""))).alias("context"))
    whole = (F.col("question") != "") & (F.col("context") != "")
    rejected = r.where(~whole).select("id", "question", F.lit(None).cast("string").alias("answer"), F.lit(REJECTED).alias("error"))
    windows = features.build_windows(r.where(whole), max_length, tokenizer=tokenizer, carry=("question", "context"))
    scored = features.infer(windows, predict)
    answer = decode.serving_answer(*(F.col(c) for c in ("context", "offsets", "start_logits", "end_logits", "attention_mask")))
    return scored.select("id", "question", answer.alias("answer"), F.lit(None).cast("string").alias("error")).unionByName(rejected)


def predict_one(spark: SparkSession, question: str | None, context: str | None, predict: Callable, **how) -> dict[str, str]:
    """One request through the same plan: {question, answer} or {error}."""
    row = respond(spark.createDataFrame([("1", question, context)], REQUEST).coalesce(1), predict, **how).first()
    return {"error": row["error"]} if row["error"] else {"question": row["question"], "answer": row["answer"]}
