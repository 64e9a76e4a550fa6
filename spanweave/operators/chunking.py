"""Overlapping context windows and the placing of answers in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(text: str, size: int = 500, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end): about ``size`` characters, extended to the next blank; the next window
    begins with the word that holds the position ``overlap`` before the end, and always later
    than the one before."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    out, at = [], 0
    while True:
        end = min(at + size, n)
        if end < n:
            blank = text.find(" ", end)
            end = n if blank < 0 else blank
        out.append((at, end))
        if end >= n:
            return out
        nxt = text.rfind(" ", 0, max(end - overlap, 0)) + 1
        at = nxt if at < nxt < end else end


def with_windows(df: DataFrame, context: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """Add ``windows``, array of (start, end); contexts within ``size`` do not leave the JVM."""
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else [{"start": a, "end": b} for a, b in windows(t, size, overlap)] for t in s], dtype=object)

    c = F.col(context)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(c).alias("end")))
    return df.withColumn("windows", F.when(c.isNotNull(), F.coalesce(cut(F.when(F.length(c) > size, c)), whole)))


def split_contexts(df: DataFrame, key: str, context: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, sub_idx from 1, sub_id, start_idx, text) for every context."""
    return (
        with_windows(df.where(F.col(context).isNotNull()).select(key, F.col(context).alias("context")), "context", size, overlap)
        .select(key, "context", F.posexplode("windows").alias("i", "w"))
        .select(
            key, (F.col("i") + 1).alias("sub_idx"), F.concat(F.col(key), F.format_string("_%02d", F.col("i") + 1)).alias("sub_id"),
            F.col("w.start").alias("start_idx"), F.substring("context", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"),
        )
    )


def place_answers(questions: DataFrame, contexts: DataFrame, size: int = 500, overlap: int = 100, compat: bool = False) -> DataFrame:
    """The sub-context of each question, and the answer's start in it.

    ``questions``: id, context_id, is_impossible, answer_text, answer_start; ``contexts``:
    context_id, context. Impossible questions go to the first sub-context. Others go to the
    closest one that holds the answer: the nearest start, then its successor, then its
    predecessor, then the first of all. With ``compat`` nearness is measured from the running
    sum of lengths instead of the true start. Questions without text or start are left out;
    lost ones (held nowhere) have a null ``sub_id``.

    Each question meets its context once, not every window's text; windows beyond the three
    nearest are looked at only where those do not hold the answer.
    """
    q = questions.where("is_impossible or (answer_text is not null and answer_start is not null)")
    cut = with_windows(contexts.where("context is not null").select("context_id", "context"), "context", size, overlap)
    if compat:
        sums = F.aggregate("windows", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, w: F.struct(
            (s["at"] + w["end"] - w["start"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        cut = cut.withColumn("places", sums)
    else:
        cut = cut.withColumn("places", F.col("windows.start"))
    near = F.array_min(F.transform("places", lambda p, i: F.struct(F.abs(F.col("answer_start") - p).alias("d"), i.alias("i"))))["i"]
    j = q.join(cut, "context_id").withColumn("near", F.when(F.col("is_impossible"), 0).otherwise(near))

    def hit(i):
        w = F.get("windows", i)
        return F.instr(F.substring(F.col("context"), w["start"] + 1, w["end"] - w["start"]), F.col("answer_text"))

    at = F.when(F.col("is_impossible"), F.lit(0))
    for i in (F.col("near"), F.col("near") + 1, F.col("near") - 1):
        at = at.when((i >= 0) & (hit(i) > 0), i)
    anywhere = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: hit(i) > 0)
    at = at.when(F.contains("context", "answer_text"), F.get(anywhere, F.lit(0)))
    j = j.withColumn("at", at)
    return j.select(
        "id", "context_id", "is_impossible", F.when(F.col("at").isNotNull(), F.concat("context_id", F.format_string("_%02d", F.col("at") + 1))).alias("sub_id"),
        F.when(~F.col("is_impossible") & F.col("at").isNotNull(), hit(F.col("at")) - 1).alias("answer_start"),
    )
