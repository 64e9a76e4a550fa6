"""Start and end scores turned into answer spans; native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(a: Column) -> Column:
    """Index of the first greatest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmax_span(start: Column, end: Column, swap: bool = False) -> Column:
    """struct(s, e) of the two best positions; reversed ones are swapped, or give null."""
    s, e = argmax(start), argmax(end)
    if swap:
        return F.struct(F.least(s, e).alias("s"), F.greatest(s, e).alias("e"))
    return F.when(s <= e, F.struct(s.alias("s"), e.alias("e")))


def serving_span(start: Column, end: Column, mask: Column | None = None) -> Column:
    """Best positions among unmasked ones; a reversed end is moved to the start."""
    if mask is not None:
        low = F.lit(float("-inf"))
        start = F.zip_with(start, mask, lambda v, m: F.when(m == 1, v).otherwise(low))
        end = F.zip_with(end, mask, lambda v, m: F.when(m == 1, v).otherwise(low))
    s, e = argmax(start), argmax(end)
    return F.struct(s.alias("s"), F.greatest(s, e).alias("e"))


def _top(a: Column, n: int) -> Column:
    """The n best (score, position) pairs; ties by the smaller position."""
    pairs = F.transform(a, lambda v, i: F.struct((-v.cast("double")).alias("k"), i.alias("i")))
    return F.slice(F.array_sort(pairs), 1, n)


def nbest_span(start: Column, end: Column, n: int = 20, longest: int = 100, null_threshold: float | None = 0.0, cls: int = 0) -> Column:
    """Best legal pair of the n best starts and ends: struct(score, s, e), or null.

    Legal: end at or after start, at most ``longest`` tokens. Ties: the smaller start, then the
    smaller end. With a threshold, null where the pair does not beat the score of position
    ``cls`` by it.
    """
    starts, ends = _top(start, n), _top(end, n)
    pairs = F.flatten(F.transform(starts, lambda a: F.transform(ends, lambda b: F.struct(
        (a["k"] + b["k"]).alias("k"), a["i"].alias("s"), b["i"].alias("e")
    ))))
    legal = F.filter(pairs, lambda p: (p["e"] >= p["s"]) & (p["e"] - p["s"] + 1 <= longest))
    best = F.array_min(legal)
    out = F.when(best.isNotNull(), F.struct((-best["k"]).alias("score"), best["s"].alias("s"), best["e"].alias("e")))
    if null_threshold is None:
        return out
    none = F.get(start, F.lit(cls)).cast("double") + F.get(end, F.lit(cls)).cast("double")
    return F.when(-best["k"] - none >= null_threshold, out)


def span_text(context: Column, offsets: Column, span: Column) -> Column:
    """Text from the first token's start to the last token's end; '' for a null span or one out of range."""
    a = F.get(offsets, span["s"])
    b = F.get(offsets, F.least(span["e"], F.size(offsets) - 1))
    return F.coalesce(F.substring(context, a["s"] + 1, b["e"] - a["s"]), F.lit(""))


# Fixed value: what serving answers where there is no answer.
NO_ANSWER = "No answer found in the given context."


def serving_answer(context: Column, offsets: Column, start: Column, end: Column, mask: Column | None = None) -> Column:
    """The online decoder's text: fixed text where the first token wins on both sides, and also
    where the span begins or ends at offset 0 (so an answer at the very start is not given)."""
    span = serving_span(start, end, mask)
    a, b = F.get(offsets, span["s"])["s"], F.get(offsets, span["e"])["e"]
    none = ((span["s"] == 0) & (span["e"] == 0)) | (F.coalesce(a, F.lit(0)) == 0) | (F.coalesce(b, F.lit(0)) == 0)
    return F.when(none, NO_ANSWER).otherwise(F.substring(context, a + 1, F.greatest(b - a, F.lit(0))))
