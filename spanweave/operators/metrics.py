"""Scores of predicted answers: native column expressions and aggregates; n-gram counters and
subsequences, which native expressions can only do in quadratic time, in Arrow batches."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def exact_match(pred: Column, gold: Column, normalize=tx.normalize_script) -> Column:
    return (normalize(F.coalesce(pred, F.lit(""))) == normalize(F.coalesce(gold, F.lit("")))).cast("double")


def f1(pred: Column, gold: Column, normalize=tx.normalize_script) -> Column:
    """Set overlap over list lengths: repeated tokens lower it. Either side empty: equality."""
    p, g = tx.tokens(normalize(F.coalesce(pred, F.lit("")))), tx.tokens(normalize(F.coalesce(gold, F.lit(""))))
    both = F.size(F.array_intersect(p, g))
    return (
        F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double"))
        .when(both == 0, 0.0)
        .otherwise(2.0 * both / (F.size(p) + F.size(g)))
    )


def clipped_hits(pred: list, gold: list, n: int) -> int:
    """N-grams of ``pred`` that ``gold`` has too, each counted at most as often as there."""
    if n == 1:
        a, b = Counter(pred), Counter(gold)
    else:
        a, b = (Counter(zip(*(t[k:] for k in range(n)))) for t in (pred, gold))
    return sum(min(c, b[g]) for g, c in a.items() if g in b)


def clipped(pred: Column, gold: Column, orders: int) -> Column:
    """Array of the clipped n-gram hits of two token arrays for the orders 1 to ``orders``.

    Hash counters in Arrow batches: linear in the tokens. Distinct pairs of a batch count once.
    """
    @F.pandas_udf("array<int>")
    def count(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [clipped_hits(list(x), list(y), n) for n in range(1, orders + 1)] for x, y in zip(p, g)], dtype=object)

    return count(pred, gold)


# Weights of the BLEU orders.
BLEU_WEIGHTS = {1: [1.0], 2: [0.5, 0.5], 3: [0.33, 0.33, 0.34], 4: [0.25] * 4}


def bleu_parts(pred: Column, gold: Column, orders: int) -> dict[str, Column]:
    """Clipped and total counts per order, and both lengths; sums of these give corpus BLEU."""
    p, g = tx.tokens(pred), tx.tokens(gold)
    hits = clipped(p, g, orders)
    out = {"pred_len": F.size(p), "gold_len": F.size(g)}
    for n in range(1, orders + 1):
        out[f"hit{n}"], out[f"all{n}"] = hits[n - 1], F.greatest(F.size(p) - n + 1, F.lit(0))
    return out


def bleu_from(parts: dict[str, Column], order: int, smooth: bool = True) -> Column:
    """BLEU from counts. Smoothed: a zero count at orders above 1 counts as 0.1."""
    logs = []
    for n, w in enumerate(BLEU_WEIGHTS[order], 1):
        hit, total = parts[f"hit{n}"].cast("double"), F.greatest(parts[f"all{n}"], F.lit(1)).cast("double")
        logs.append(F.lit(w) * F.log(F.when(hit > 0, hit).otherwise(0.1) / total))
    short = F.when(parts["pred_len"] > parts["gold_len"], 0.0).otherwise(1.0 - parts["gold_len"] / F.greatest(parts["pred_len"], F.lit(1)))
    zero = parts["hit1"] == 0
    if not smooth:
        zero = reduce(lambda a, b: a | b, [parts[f"hit{n}"] == 0 for n in range(1, order + 1)])
    return F.when(zero | (parts["pred_len"] == 0) | (parts["gold_len"] == 0), 0.0).otherwise(F.exp(short + reduce(lambda a, b: a + b, logs)))


def lcs_of_lists(a: list, b: list) -> int:
    """Longest common subsequence by bit-parallel rows."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def token_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays."""
    return pd.Series([None if x is None or y is None else lcs_of_lists(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


def rouge_tokens(x: Column, unicode: bool = False, stem: bool = False) -> Column:
    """Lower-cased runs of ASCII letters and digits, or of all letters, marks and digits; with
    ``stem`` words of more than three characters are reduced to their stem."""
    gap = r"[^\p{L}\p{M}\p{N}]+" if unicode else "[^a-z0-9]+"
    tokens = F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), gap), lambda t: t != "")
    return _stemmed(tokens) if stem else tokens


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pd.Series) -> pd.Series:
    from ..functions.stemmer import stem

    return pd.Series([None if t is None else [stem(w) if len(w) > 3 else w for w in t] for t in tokens], dtype=object)


def _f_measure(hit: Column, p: Column, g: Column) -> Column:
    return F.when((hit == 0) | (p <= 0) | (g <= 0), 0.0).otherwise(2.0 * hit / (p + g))


def rouge_n(pred: Column, gold: Column, orders: int = 2, unicode: bool = False, stem: bool = False) -> list[Column]:
    """F-measures of the n-gram overlaps for the orders 1 to ``orders``."""
    p, g = rouge_tokens(pred, unicode, stem), rouge_tokens(gold, unicode, stem)
    hits = clipped(p, g, orders)
    return [_f_measure(hits[n - 1], F.size(p) - n + 1, F.size(g) - n + 1) for n in range(1, orders + 1)]


def rouge_l(pred: Column, gold: Column, unicode: bool = False, stem: bool = False) -> Column:
    p, g = rouge_tokens(pred, unicode, stem), rouge_tokens(gold, unicode, stem)
    return _f_measure(token_lcs(p, g), F.size(p), F.size(g))


def blank(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), tx.WS + "+", "") == ""


def impossible_accuracy(pred: Column, gold: Column) -> Column:
    """Aggregate: percent of blank golds with blank predictions; 100 if there is none."""
    n = F.count_if(blank(gold))
    return F.coalesce(100.0 * F.count_if(blank(gold) & blank(pred)) / F.nullif(n, F.lit(0)), F.lit(100.0))


def confusion(pred: Column, gold: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn of 'has an answer'."""
    p, g = ~blank(pred), ~blank(gold)
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")]


def derived(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, fn, tn; zero where undefined."""
    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select(
        "*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def error_type(pred: Column, gold: Column) -> Column:
    """Ordered classes of an answer; a gold and a prediction that normalize alike are correct."""
    em, score = exact_match(pred, gold), f1(pred, gold)
    return (
        F.when(em == 1.0, "Correct")
        .when(blank(gold) & ~blank(pred), "Unanswerable FP")
        .when(~blank(gold) & blank(pred), "Unanswerable FN")
        .when((score > 0) & (score < 1), "Partial Span")
        .when(score == 0, "No Overlap")
        .otherwise("Other")
    )


def histogram(df: DataFrame, value: str, low: int = 0, high: int = 28, step: int = 2) -> DataFrame:
    """Bins of ``step`` from ``low`` to ``high``; the last is closed, values beyond are left out."""
    v = F.col(value)
    inside = df.where((v >= low) & (v <= high))
    bin_ = F.least(F.floor((v - low) / step), F.lit((high - low) // step - 1))
    return inside.groupBy((bin_ * step + low).cast("long").alias("bin_start")).agg(F.count("*").alias("n"))


def complete(examples: DataFrame, predictions: DataFrame, key: str = "id", pred: str = "pred") -> DataFrame:
    """``examples`` with their predictions; missing and null ones are empty, others are dropped."""
    return examples.join(predictions.select(key, pred), key, "left").withColumn(pred, F.coalesce(pred, F.lit("")))
