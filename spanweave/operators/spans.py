"""Answer spans: exact and fuzzy validation, best-window search, realignment."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.lexicon import Lexicon
from ..functions.similarity import best_possible, indel_ratio, sequence_ratio, token_similarity


def span_at(context: Column, start: Column, length: Column) -> Column:
    """``context[start:start+length]`` for start >= 0."""
    return F.substring(context, start + 1, length)


def exact_verdict(context: Column, answer: Column, start: Column) -> Column:
    """'ok', 'missing', 'out of bounds', 'beyond end', 'found at N' or 'not found'."""
    found = F.instr(context, answer)
    return (
        F.when(context.isNull() | answer.isNull() | start.isNull(), "missing")
        .when((start < 0) | (start >= F.length(context)), "out of bounds")
        .when(start + F.length(answer) > F.length(context), "beyond end")
        .when(span_at(context, start, F.length(answer)) == answer, "ok")
        .when(found > 0, F.concat(F.lit("found at "), (found - 1).cast("string")))
        .otherwise("not found")
    )


def diagnosed(df: DataFrame, context: str, answer: str, start: str, margin: int = 50) -> DataFrame:
    """Add verdict, snippet and, unless the verdict is ok, the places of the answer (n_places,
    places joined by commas; null where there are none). Filter by id for a single question."""
    c, a, s = F.col(context), F.col(answer), F.col(start)
    out = df.withColumn("verdict", exact_verdict(c, a, s))
    places = F.when(F.col("verdict") != "ok", tx.find_all(c, a)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_places", places).withColumn("n_places", F.size("_places").cast("long"))
    joined = F.array_join(F.transform("_places", lambda x: x.cast("string")), ",")
    return out.withColumns({"snippet": tx.snippet(c, s, F.length(a), margin), "places": F.nullif(joined, F.lit(""))}).drop("_places")


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sequence_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def with_fuzzy_valid(df: DataFrame, context: str, answer: str, start: str, threshold: float = 0.9, out: str = "valid", endings: list[str] | None = None) -> DataFrame:
    """Add ``out``: the span equals the answer but for white space and case, or nearly does.

    Bounds and equality are native; only rows that are left reach the UDF (others send nulls).
    Empty or null answers and spans out of bounds are invalid. The stricter variant strips
    ``endings`` (see ``functions.text.VALIDATOR_ENDINGS``) from both sides first.
    """
    c, a, s = F.col(context), F.col(answer), F.col(start)
    inside = F.coalesce((F.length(a) > 0) & (s >= 0) & (s + F.length(a) <= F.length(c)), F.lit(False))
    span, want = tx.squeeze_lower(span_at(c, s, F.length(a))), tx.squeeze_lower(a)
    if endings:
        span, want = tx.strip_ending(span, endings), tx.strip_ending(want, endings)
    left = inside & (span != want)
    ratio = _sequence_ratio(F.when(left, span), F.when(left, want))
    return df.withColumn(out, inside & ((span == want) | F.coalesce(ratio >= threshold, F.lit(False))))


def question_verdicts(answers: DataFrame) -> DataFrame:
    """A question is valid if any of its answers (plausible ones if impossible) is valid.

    ``answers``: qa_id, is_impossible, is_plausible, valid; questions without candidates are
    added by the caller through an outer join.
    """
    counts = (F.col("is_plausible") == F.col("is_impossible")) & F.col("valid")
    return answers.groupBy("qa_id", "is_impossible").agg(F.max(counts.cast("int")).cast("boolean").alias("valid"))


class WindowSearch:
    """Best window of a context for an answer, by spelling, tokens and meaning."""

    def __init__(self, lexicon: Lexicon | None = None, extra_words: int = 3, bonus: float = 20.0, partial: float = 0.8, low: int = 0x0C00):
        self.lexicon, self.low = lexicon or Lexicon(), low
        self.extra_words, self.bonus, self.partial = extra_words, bonus, partial

    def meaning(self, window: list[str], answer: list[str]) -> float:
        """Equivalent pairs of base forms over the longer length; may exceed 1 with repeated words."""
        if not window or not answer:
            return 0.0
        same = self.lexicon.equivalent
        return sum(same(a, b) for a in window for b in answer) / max(len(window), len(answer))

    def search(self, context: str, answer: str) -> tuple[int, int, str, float]:
        """(start, end, window, score) on the squeezed context; (0, 0, '', 0) if nothing scores."""
        words, want = context.split(), answer.split()
        target = " ".join(want)
        n = len(want)
        base = self.lexicon.base
        want_bases = [base(w) for w in want]
        bases = [base(w) for w in words]
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        # Per word of the context: how many of the answer's words it is equivalent to. Prefix sums
        # of these, and of where each base of the answer stands, judge a window in constant time.
        same = self.lexicon.equivalent
        kinds = {w: sum(same(w, x) for x in want_bases) for w in set(bases)}
        alike = list(accumulate((kinds[w] for w in bases), initial=0))
        needed = [list(accumulate((w == x for w in bases), initial=0)) for x in set(want_bases)]
        possible = "" not in want_bases
        low = target.lower()
        best: tuple[float, int, int] | None = None
        for i in range(len(words)):
            for size in range(max(n, 1), min(n + self.extra_words, len(words) - i) + 1):
                end = i + size
                meaning = (alike[end] - alike[i]) / max(size, n) if n else 0.0
                complete = possible and all(c[end] > c[i] for c in needed)
                length = starts[end - 1] + len(words[end - 1]) - starts[i]
                top = 100 * (0.4 * best_possible(length, len(target)) + 0.3 + 0.3 * meaning) + self.bonus * complete
                if best is not None and top <= best[0]:
                    continue  # even the best spelling could not win
                window = " ".join(words[i:end]).lower()
                ratio = indel_ratio(window, low)
                top = 100 * (0.4 * ratio + 0.3 + 0.3 * meaning) + self.bonus * complete
                if best is not None and top <= best[0]:
                    continue  # nor could the best tokens
                score = 100 * (0.4 * ratio + 0.3 * token_similarity(window, low) + 0.3 * meaning) + self.bonus * complete
                if score > 0 and (best is None or score > best[0]):
                    best = (score, i, size)
        if best is None:
            return 0, 0, "", 0.0
        score, i, size = best
        window = " ".join(words[i : i + size])
        place = self.place(" ".join(words), window, starts[i])
        return place, place + len(window), window, score

    def at_boundary(self, text: str, i: int) -> bool:
        """At the ends, or where this or the previous character lies below the script block."""
        return i <= 0 or i >= len(text) or ord(text[i]) < self.low or ord(text[i - 1]) < self.low

    def place(self, context: str, window: str, about: int) -> int:
        """Exact place of ``window`` near ``about``: the first exact one at a character boundary,
        else the best similar one (the first of equals), else ``about``.

        Looked at are two window lengths on both sides, widened to boundaries.
        """
        lo, hi = max(0, about - 2 * len(window)), min(len(context), about + 2 * len(window))
        while not self.at_boundary(context, lo):
            lo -= 1
        while not self.at_boundary(context, hi):
            hi += 1
        part = context[lo:hi]
        at = part.find(window)
        while at >= 0:
            if self.at_boundary(part, at):
                return lo + at
            at = part.find(window, at + 1)
        best, where = 0.0, about
        for p in range(len(part)):
            if self.at_boundary(part, p):
                r = indel_ratio(part[p : p + len(window)], window)
                if r >= self.partial and r > best:
                    best, where = r, lo + p
        return where

    def realign(self, context: str, answer: str, compat: bool = False) -> tuple[int, str, float]:
        """(answer_start, text, score) in the context as given.

        The search runs on squeezed text; by default offsets are mapped back, with ``compat``
        they are used as they are.
        """
        squeezed = " ".join(context.split())
        start, end, window, score = self.search(squeezed, " ".join(answer.split()))
        if not window:
            return 0, "", 0.0
        if compat or squeezed == context:
            return start, context[start:end], score
        origin, i = [], 0
        for word in context.split():
            i = context.index(word, i)
            origin += list(range(i, i + len(word) + 1))
            i += len(word)
        a = origin[start]
        b = origin[end - 1] + 1
        return a, context[a:b], score


def realigned(df: DataFrame, context: str, answer: str, low: float = 45.0, compat: bool = False) -> DataFrame:
    """Add new_start, new_text, score and low (score below ``low``) by window search."""
    # The search takes far longer than moving the rows does: spread them over all cores.
    sc = df.sparkSession.sparkContext
    df = df.repartition(max(sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    @F.pandas_udf("struct<new_start:int,new_text:string,score:double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        search = WindowSearch()
        for c, a in batches:
            rows = [search.realign(x or "", y or "", compat) for x, y in zip(c, a)]
            yield pd.DataFrame(rows, columns=["new_start", "new_text", "score"])

    out = df.withColumn("_r", run(F.col(context), F.col(answer)))
    return out.select(*df.columns, "_r.new_start", "_r.new_text", F.round("_r.score", 6).alias("score"), (F.col("_r.score") < low).alias("low"))


ANSWER = "struct<text:string,answer_start:int>"


def adjust_dataset(flat: DataFrame, low: float = 45.0, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """A flat data set with every answer placed again, and the answers of low similarity.

    ``flat``: article_idx, para_idx, qa_idx, title, context_id, context, id, question,
    is_impossible, answers, plausible_answers (see ``sources.squad.flatten``). Answerable
    questions keep adjusted ``answers``; impossible ones get none, and adjusted
    ``plausible_answers``. The text is always overwritten by what stands at the new place.

    The search runs once for each different pair of context and answer of a question's side.
    Low cases: title, context, question, id, is_impossible, answer, found_text, similarity_score.
    """
    none = F.array().cast(f"array<{ANSWER}>")
    sought = F.when(F.col("is_impossible"), F.coalesce("plausible_answers", none)).otherwise(F.coalesce("answers", none))
    key = ["article_idx", "para_idx", "qa_idx"]
    each = flat.select(*key, "title", "context", "question", "id", "is_impossible", F.posexplode(sought).alias("at", "answer"))
    placed = realigned(each.withColumn("_text", F.coalesce("answer.text", F.lit(""))), "context", "_text", low, compat)
    new = F.struct(F.col("new_text").alias("text"), F.col("new_start").alias("answer_start"))
    per = placed.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", new.alias("a")))), lambda x: x["a"]).alias("_new"))
    found = F.coalesce("_new", none)
    adjusted = flat.join(per, key, "left").select(
        *(c for c in flat.columns if c not in ("answers", "plausible_answers")),
        F.when(F.col("is_impossible"), none).otherwise(found).alias("answers"),
        F.when(F.col("is_impossible"), found).otherwise(none).alias("plausible_answers"),
    )
    lows = placed.where("low").select(
        "title", "context", "question", "id", "is_impossible", "answer", F.col("new_text").alias("found_text"), F.col("score").alias("similarity_score"), *key, "at"
    )
    return adjusted, lows


def low_report(lows: DataFrame, part: int = 1000) -> DataFrame:
    """The low cases in nested form, (title, part, paragraphs): one entry a case, articles of one
    title together. A title with many cases gets several rows of ``part`` cases at most."""
    q = F.struct("question", "id", F.when(~F.col("is_impossible"), F.array("answer")).alias("answers"),
                 F.when(F.col("is_impossible"), F.array("answer")).alias("plausible_answers"), "found_text", "similarity_score")
    entry = F.struct("context", F.array(q).alias("qas"))
    order = Window.partitionBy("title", F.col("article_idx"), F.floor(F.col("para_idx") / 100)).orderBy("para_idx", "qa_idx", "at")
    numbered = lows.withColumn("part", F.concat_ws("-", "article_idx", F.floor(F.col("para_idx") / 100), F.floor((F.row_number().over(order) - 1) / part)))
    item = F.struct("article_idx", "para_idx", "qa_idx", "at", entry.alias("e"))
    return numbered.groupBy("title", "part").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("paragraphs"))


def by_occurrence(source_text: Column, source_answer: Column, source_start: Column, text: Column, answer: Column) -> Column:
    """The start in ``text`` of the occurrence of ``answer`` that has the rank which the source's
    start has among the occurrences of ``source_answer``; the last one where there are fewer.

    The source's answer and its translation are different strings, each sought in its own text.
    """
    rank = F.size(F.filter(tx.find_all(source_text, source_answer), lambda p: p < source_start))
    places = tx.find_all(text, answer)
    return F.coalesce(F.get(places, rank), F.get(places, F.size(places) - 1))
