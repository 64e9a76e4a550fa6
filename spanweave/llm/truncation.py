"""Texts cut off by field limits or in transfer (problem 5).

Method: per source and column, histograms of the lengths in characters and in bytes are tested
for spikes at the maximum. A text without terminal punctuation whose length is such a spike is
flagged. Cuts in transfer leave no spike; for them the ending itself is judged: what a cut
leaves behind (part of an escape, a replacement character), or an ending that, by counts over
the whole corpus, does not end sentences. The same counts keep finished sentences that only
lack their stop from being flagged. Answers, which rarely end with punctuation, are looked up
in their passage: one at a spike length is cut if its last word is a part of a passage's word,
any other only if the whole answer stops inside a word there.

Nulls and blank texts are never flagged. Ties have no effect, as nothing is ordered.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tables import CUT_MARKS

_WORD_CHAR = "[\\p{L}\\p{M}\\p{N}]"
_STOPPED = "[.?!।][\"”’'»)\\]}]*\\s*$"


def ends_open(text: Column) -> Column:
    """A text with content whose last sentence has no terminal punctuation."""
    cut = text.rlike(CUT_MARKS)
    return F.coalesce(text.rlike("\\S") & (cut | ~text.rlike(_STOPPED)), F.lit(False))


_UNITS = ("chars", "bytes")


def with_lengths(df: DataFrame, text: str) -> DataFrame:
    """Add ``open`` (see ``ends_open``), ``chars`` and ``bytes`` of a text column."""
    t = F.col(text)
    return df.withColumns({"open": ends_open(t), "chars": F.length(t), "bytes": F.octet_length(t)})


def length_profile(df: DataFrame) -> DataFrame:
    """Histogram per source and unit of (source, open, chars, bytes): how many texts have each
    length, and how many of them end open."""
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in _UNITS)))
    return (
        df.where(F.col("chars").isNotNull())
        .select(F.coalesce("source", F.lit("")).alias("source"), F.col("open").cast("int").alias("open"), units.alias("u"))
        .groupBy("source", "u.unit", "u.length")
        .agg(F.count("*").alias("n"), F.sum("open").alias("n_open"))
    )


def at_spike(df: DataFrame, spikes: DataFrame) -> DataFrame:
    """(row_id, spike = true) for the open rows of (row_id, source, open, chars, bytes) at a spike length."""
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in _UNITS)))
    return (
        df.where("open").select("row_id", F.coalesce("source", F.lit("")).alias("source"), units.alias("u"))
        .select("row_id", "source", "u.unit", "u.length").join(spikes, ["source", "unit", "length"], "left_semi")
        .select("row_id", F.lit(True).alias("spike")).distinct()
    )


def length_spikes(profile: DataFrame, least: int = 4, share: float = 0.05, times: float = 6.0) -> DataFrame:
    """Lengths at which open texts pile up at a maximum: (source, unit, length, n_open).

    A spike holds at least ``least`` open texts and ``share`` of the source's open texts, and
    with the 2 lengths above (a replacement character may take up to 2 bytes more) ``times`` as
    many as the 8 above those together: what is cut at a limit never passes it. The window runs over the histogram, whose size is bounded by the number of lengths.
    """
    from pyspark.sql import Window

    per = Window.partitionBy("source", "unit")
    by_length = per.orderBy("length")
    return (
        profile.withColumn("here", F.sum("n_open").over(by_length.rangeBetween(0, 2)))
        .withColumn("above", F.coalesce(F.sum("n_open").over(by_length.rangeBetween(3, 10)), F.lit(0)))
        .withColumn("all_open", F.sum("n_open").over(per))
        .where((F.col("n_open") >= least) & (F.col("n_open") >= share * F.col("all_open")))
        .where((F.col("here") >= times * F.col("above")) & (F.col("n_open") >= 0.5 * F.col("n")))
        .select("source", "unit", "length", "n_open")
    )


#: Weight of the less specific ending's share.
_DRAWN = 2.0
_STRIP = " \t\r\n\"“”‘’'()[]{}«»•*-–—_"
_TE = re.compile("[\\u0c00-\\u0c7f\\u0900-\\u097f]")


def word_class(token: str) -> str:
    """The class under which a word's endings are counted: numbers and names are pooled."""
    w = token.strip(_STRIP).rstrip(".?!।,;:").strip(_STRIP)
    if not w:
        return ""
    comma = "," if token[-1:] in ",;:" else ""
    if w[0].isdigit():
        tail = w.lstrip("0123456789౦౧౨౩౪౫౬౭౮౯")
        return "#" + _named(tail) + comma
    if w[0].isupper():
        return "N" + comma
    return _named(w) + comma


def _named(w: str) -> str:
    """The word itself; a very long one by its hash."""
    return w if len(w) <= 24 else "~" + hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()


def _ending_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict = defaultdict(int)
    final: dict = defaultdict(int)
    known: dict[str, tuple[str, bool]] = {}
    stops = (".", "?", "!", "।")
    for pdf in batches:
        for text in pdf["text"]:
            if not text:
                continue
            a = b = "^"
            for token in text.split():
                hit = known.get(token)
                if hit is None:
                    bare = token.rstrip("\"”’'»)]}")
                    hit = (word_class(token), bare[-1:] in stops and not bare.endswith("..."))
                    if len(known) < 300_000:
                        known[token] = hit
                c, ends = hit
                if not c:
                    continue
                total[c] += 1
                if ends:
                    final[c] += 1
                if not _TE.match(c[0]):
                    g2, g3 = (b, c), (a, b, c)
                    total[g2] += 1
                    total[g3] += 1
                    if ends:
                        final[g2] += 1
                        final[g3] += 1
                a, b = (b, c) if not ends else ("^", "^")
        if len(total) > 400_000:
            yield _counts_frame(total, final)
            total.clear()
            final.clear()
    yield _counts_frame(total, final)


def _counts_frame(total: dict, final: dict) -> pd.DataFrame:
    grams = [g if isinstance(g, str) else " ".join(g) for g in total]
    return pd.DataFrame({"gram": grams, "total": list(total.values()), "final": [final.get(g, 0) for g in total]})


def ending_counts(df: DataFrame, text: str) -> DataFrame:
    """For each ending of one to three words: how often it occurs, and how often it ends a sentence."""
    rows = df.select(F.col(text).alias("text")).mapInPandas(_ending_counts, "gram string, total long, final long")
    return rows.groupBy("gram").agg(F.sum("total").alias("total"), F.sum("final").alias("final"))


_CUT = re.compile("(?:…|\\.\\.\\.|�+|&#?[A-Za-z0-9]{0,7}|\\\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)\\s*$")


def _open_endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For open texts: whether the ending alone shows a cut, and the endings to look up."""
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["row_id"], pdf["text"]):
            verdict, grams = judge_ending(text)
            rows += [(key, verdict, rank, g) for rank, g in enumerate(grams)] or [(key, verdict, 0, None)]
        yield pd.DataFrame(rows, columns=["row_id", "verdict", "rank", "gram"])


def judge_ending(text: str) -> tuple[str, list[str]]:
    """("cut" | "look", endings from the most to the least specific)."""
    if _CUT.search(text):
        return "cut", []
    if text.rstrip(" ")[-1:] in (",", ";", ":", "(", "-", "–"):
        return "cut", []
    tokens = [t for t in re.split(r"[\s_]+", text) if t]
    if not tokens:
        return "look", []
    last = tokens[-1]
    if len(last) > 60:
        if _TE.search(last[-8:]):
            return "look", [last[-n:] for n in range(24, 3, -1)]
        return "whole", []
    classes: list[str] = []
    for t in reversed(tokens):
        c = word_class(t)
        if c:
            if classes and t.rstrip("\"”’'»)]}")[-1:] in (".", "?", "!", "।"):
                classes += ["^", "^"]
            else:
                classes.append(c)
        if len(classes) >= 3:
            break
    classes = (classes + ["^", "^"])[:3]
    c, b, a = classes
    if c == "N":
        bare = last.strip(_STRIP)
        words = set(re.findall(r"[^\W\d_]+", text[: -len(last)]))
        if bare not in words and any(w.startswith(bare) and len(w) > len(bare) for w in words):
            return "cut", []
    if _TE.match(c[:1] or "x"):
        return "look", [c]
    return "look", [f"{a} {b} {c}", f"{b} {c}", c]


def cut_texts(df: DataFrame, row_id: str, text: str, source: str = "source", counts_from: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose ``text`` was cut off: (row_id, source, reason).

    reason is ``mark`` (a cut's remains or a dangling ending), ``spike`` (a length at which the
    source's open texts pile up) or ``ending`` (the ending does not end sentences elsewhere).
    """
    base = df.select(
        F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text"), F.coalesce(source, F.lit("")).alias("source")
    )
    measured = with_lengths(base, "text")
    open_rows = materialize(measured.where("open"), "open")
    spikes = length_spikes(length_profile(measured))
    at_limit = at_spike(open_rows, spikes)
    endings = open_rows.select("row_id", "text").mapInPandas(_open_endings, "row_id string, verdict string, rank int, gram string")
    endings = materialize(endings, "endings")
    needed = endings.where("gram is not null").select("gram").distinct()
    counts = ending_counts(base if counts_from is None else counts_from, "text").join(needed, "gram", "left_semi")
    # From the least to the most specific ending: each share is drawn to the one before it.
    seen = F.reverse(F.array_sort(F.collect_list(F.when(F.col("total").isNotNull(), F.struct("rank", "total", "final")))))
    share = F.aggregate(seen, F.lit(0.0), lambda p, x: (x["final"] + _DRAWN * p) / (x["total"] + _DRAWN))
    looked = endings.join(counts, "gram", "left").groupBy("row_id").agg(F.first("verdict").alias("verdict"), share.alias("p"))
    return (
        open_rows.select("row_id", "source").join(looked, "row_id").join(at_limit, "row_id", "left")
        .withColumn("reason", F.when(F.col("verdict") == "cut", "mark")
                    .when(F.col("spike"), "spike")
                    .when((F.col("verdict") == "look") & (F.coalesce("p", F.lit(0.0)) < 0.5), "ending"))
        .where("reason is not null").select("row_id", "source", "reason").dropDuplicates(["row_id"])
    )


def cut_answers(judged: DataFrame) -> DataFrame:
    """Cut rows of (row_id, source, open, chars, bytes, inside, partial): (row_id, source, reason).

    ``inside``: the answer stops inside a word of its passage; ``partial``: it does not stand
    there, but its last word is only a part of a word there. reason is ``spike`` or ``passage``.
    """
    limited = at_spike(judged, length_spikes(length_profile(judged)))
    return (
        judged.where("inside or partial").join(limited, "row_id", "left")
        .withColumn("reason", F.when(F.col("spike"), "spike").when(F.col("inside"), "passage"))
        .where("reason is not null").select("row_id", "source", "reason")
    )


def stops_inside_word(answer: Column, context: Column, start: Column) -> Column:
    """Whether ``answer`` ends inside a word of ``context``.

    What a cut leaves behind is not part of the answer. Where the answer stands at ``start``,
    that place decides; elsewhere all its places must be inside words.
    """
    bare = F.regexp_replace(answer, CUT_MARKS, "")
    there = F.substring(context, start + 1, F.length(bare)) == bare
    follows = F.substring(context, start + 1 + F.length(bare), F.lit(1))
    quoted = F.concat(F.lit("\\Q"), F.regexp_replace(bare, "\\\\E", ""), F.lit("\\E(?!" + _WORD_CHAR + ")"))
    inside = (
        F.when(start.isNotNull() & (start >= 0) & there, follows.rlike(_WORD_CHAR))
        .when(F.contains(context, bare), ~F.regexp_like(context, quoted))
        .otherwise(F.lit(False))
    )
    return F.coalesce((F.length(F.trim(bare)) > 0) & bare.rlike(_WORD_CHAR + "$") & inside, F.lit(False))


def last_word_is_part(answer: Column, context: Column) -> Column:
    """Whether an answer that does not stand in ``context`` ends in a word that only begins one there."""
    bare = F.regexp_replace(answer, CUT_MARKS, "")
    word = F.regexp_extract(bare, "(" + _WORD_CHAR + "+)$", 1)
    begins, whole = (F.concat(F.lit("(?<!" + _WORD_CHAR + ")\\Q"), word, F.lit("\\E" + end)) for end in (_WORD_CHAR, "(?!" + _WORD_CHAR + ")"))
    asked = (F.length(word) > 0) & ~F.contains(context, bare) & F.contains(context, word)
    return F.coalesce(F.when(asked, F.regexp_like(context, begins) & ~F.regexp_like(context, whole)), F.lit(False))
