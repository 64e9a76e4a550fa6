"""Translation stage with a caller's engine: distinct strings once, joined back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def translate_strings(strings: DataFrame, column: str, translate: Callable[[list[str]], list[str]], batch: int = 4) -> DataFrame:
    """(column, translated) for the distinct strings; order within a batch is kept."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[column].tolist()
            out = [t for at in range(0, len(texts), batch) for t in translate(texts[at : at + batch])]
            yield pd.DataFrame({column: texts, "translated": out})

    return strings.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, translated string")


def translate_flat(flat: DataFrame, texts: list[str], lists: list[str], translate: Callable[[list[str]], list[str]]) -> DataFrame:
    """``flat`` with its text columns and the texts of its answer arrays translated, each string by
    itself and each different string once; ``answer_start`` stays that of the original.

    All columns' strings go through the engine together; each column is joined back on a hash
    of its text, so that the texts themselves are shuffled only once.
    """
    every = [flat.select(F.col(c).alias("text")) for c in texts] + [flat.select(F.explode(c).alias("a")).select(F.col("a.text").alias("text")) for c in lists]
    strings = every[0]
    for more in every[1:]:
        strings = strings.unionByName(more)
    known = materialize(translate_strings(strings, "text", translate).select(F.sha2("text", 256).alias("h"), "translated"), "translated")
    out = flat
    for c in texts:
        out = out.withColumn("h", F.sha2(c, 256)).drop(c).join(known.withColumnRenamed("translated", c), "h", "left").drop("h")
    for c in lists:
        # One row for each answer, joined, and put together again in order, by a row key.
        out = materialize(out.withColumn("_row", F.monotonically_increasing_id()), "rows")
        each = out.select("_row", F.posexplode(c).alias("at", "a")).withColumn("h", F.sha2("a.text", 256)).join(known, "h", "left")
        new = F.struct(F.col("translated").alias("text"), F.col("a.answer_start").alias("answer_start"))
        per = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", new.alias("n")))), lambda x: x["n"]).alias("_new"))
        out = out.join(per, "_row", "left").withColumn(c, F.coalesce("_new", c)).drop("_new", "_row")
    return out.select(*flat.columns)


def word_for_word(pairs: dict[str, str]) -> Callable[[list[str]], list[str]]:
    """An engine for tests: known words are replaced, everything else stays."""
    low = {k.lower(): v for k, v in pairs.items()}

    def translate(texts: list[str]) -> list[str]:
        return [re.sub(r"[^\W\d_]+", lambda m: low.get(m.group(0).lower(), m.group(0)), t) for t in texts]

    return translate
