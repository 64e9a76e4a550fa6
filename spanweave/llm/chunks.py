"""Splitting oversized texts at natural boundaries (problem 1).

Method: content-defined chunking. A rolling hash over the last ``WINDOW`` characters marks
landmarks; a cut is the natural boundary nearest to a landmark, within minimum and maximum
sizes. As landmarks depend on the characters around them only, an edit changes the pieces near
it and no others. Boundaries rank paragraph end, sentence end, clause end, blank; where none is
in reach, the cut is made between two characters that do not combine.

Defined cases: null text gives no piece; text within the limit (also empty text) gives one
piece, itself; pieces are ordered, cover the text, do not exceed ``limit`` code points, and
each starts ``overlap`` code points before the end of the one before. Line endings and blanks
are kept, so the text can be put together again exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
# Classes of characters, as bits of a table; characters beyond it have none.
_BLANK, _NEWLINE, _COMBINING, _VIRAMA, _STOP, _CLOSER, _CLAUSE = (1 << k for k in range(7))


def _class_table() -> np.ndarray:
    import unicodedata

    table = np.zeros(0x3101, np.uint8)
    marks = [c for c in range(0x300, 0x3100) if unicodedata.category(chr(c))[0] == "M"]
    members = {
        _BLANK: [*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
        _NEWLINE: [10, 13], _COMBINING: [*marks, 0x200C, 0x200D, 0x094D, 0x0C4D],
        _VIRAMA: [0x94D, 0xC4D, 0xCCD, 0xBCD, 0xD4D, 0x200D],
        _STOP: map(ord, ".?!।…"), _CLOSER: map(ord, "\"'”’»)]}"), _CLAUSE: map(ord, ",;:–—"),
    }
    for bit, codes in members.items():
        table[np.array(list(codes))] |= bit
    return table


_CLASSES = _class_table()


def boundary_ranks(codes: np.ndarray) -> np.ndarray:
    """Rank of a cut before each character: 5 after a blank line, 4 after a line, 3 after a
    sentence, 2 after a clause, 1 after a blank, 0 within a word, -1 within a character cluster."""
    kind = _CLASSES[np.minimum(codes, len(_CLASSES) - 1)]
    blank, newline = (kind & _BLANK) > 0, (kind & _NEWLINE) > 0
    rank = np.zeros(len(codes), np.int8)
    rank[(kind & _COMBINING) > 0] = -1
    rank[1:][(kind[:-1] & _VIRAMA) > 0] = -1
    # A cut stands after the last blank of a run of blanks.
    after = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if len(after):
        starts = np.flatnonzero(~blank[:-1] & blank[1:])
        last = np.searchsorted(starts, after - 1, side="right") - 1
        ok = last >= 0
        after, before = after[ok], starts[last[ok]]  # the last character that is not blank
        lines = np.cumsum(newline & ~((codes == 10) & (np.roll(codes, 1) == 13)))
        breaks = lines[after - 1] - lines[before]
        end = kind[before]
        closed = ((end & _CLOSER) > 0) & (before > 0)
        stop = (np.where(closed, kind[np.maximum(before - 1, 0)], end) & _STOP) > 0
        r = np.where(stop, 3, np.where((end & _CLAUSE) > 0, 2, 1))
        rank[after] = np.where(breaks >= 2, 5, np.where(breaks == 1, 4, r))
    return rank


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` characters before each position, by doubling."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        factor, width = np.uint64(0x100000001B3), 1
        while width < WINDOW:
            prior = np.zeros_like(h)
            prior[width:] = h[:-width]
            h = h + prior * factor
            factor, width = factor * factor, width * 2
        out = np.zeros_like(h)
        out[1:] = h[:-1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def cut_points(rank: np.ndarray, hashed: np.ndarray, landmark: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the pieces' own parts; ``most`` is the largest own part, ``least`` the smallest."""
    n = len(rank)
    cuts: list[int] = []
    at = 0
    while n - at > most:
        lo, hi = at + least, at + most
        window = rank[lo : hi + 1]
        best = window.max()
        if best >= 3:
            level = 3
        elif best >= 1:
            level = best
        else:
            level = 0
        places = np.flatnonzero(window >= level)
        if not len(places):
            places = np.array([hi - lo])  # one unbroken cluster: nothing better exists
        marks = landmark[np.searchsorted(landmark, lo) : np.searchsorted(landmark, hi, side="right")] - lo
        if len(marks):
            # The landmark with the least hash decides; its nearest boundary is the cut.
            mark = marks[np.argmin(hashed[marks + lo])]
            near = places[np.argmin(np.abs(places - mark) * 8 - window[places])]
        else:
            near = places[np.argmin(hashed[places + lo])]
        at = int(lo + near)
        cuts.append(at)
    cuts.append(n)
    return cuts


def piece_ends(texts: list[str], limit: int, overlap: int, density: int) -> list[np.ndarray]:
    """Ends of the pieces of texts longer than ``limit``.

    Hashes and ranks are computed for all texts at once, with ``WINDOW`` zeros between them: a
    zero adds nothing to a hash, as if the text before were not there.
    """
    most = limit - overlap
    gap = "\0" * WINDOW
    codes = np.frombuffer(gap.join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashed, rank = rolling_hash(codes), boundary_ranks(codes)
    landmark = np.flatnonzero(hashed % np.uint64(density) == 0)
    out, at = [], WINDOW
    for text in texts:
        end = at + len(text)
        marks = landmark[np.searchsorted(landmark, at) : np.searchsorted(landmark, end)] - at
        out.append(np.array(cut_points(rank[at:end], hashed[at:end], marks, max(1, most // 2), most), np.int32))
        at = end + WINDOW
    return out


def split_text(text: str, limit: int = 500, overlap: int = 100, density: int = 32) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends = piece_ends([text], limit, overlap, density)[0].tolist()
    return [(max(0, start - overlap) if start else 0, end) for start, end in zip([0, *ends], ends)]


def _in_groups(texts: list[str], size: int = 400_000) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters together."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def split_texts(df: DataFrame, key: str, text: str, limit: int = 500, overlap: int = 100, density: int = 32) -> DataFrame:
    """(key, piece_no, start, length, piece) for every text of ``df``.

    Texts within the limit stay in the JVM; only longer ones are sent to Python, which returns
    offsets, and the pieces are cut out by a native expression. Rows are independent, so no
    shuffle is needed and skew has no effect.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    @F.pandas_udf("array<int>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = np.full(len(s), None, object)
            at = np.flatnonzero(s.notna().to_numpy())
            ends = [e for group in _in_groups(s.iloc[at].tolist()) for e in piece_ends(group, limit, overlap, density)]
            for i, e in zip(at, ends):
                out[i] = e
            yield pd.Series(out)

    t = F.col(text)
    ends = F.coalesce(cut(F.when(F.length(t) > limit, t)), F.array(F.length(t)))
    before = F.coalesce(F.get("ends", F.col("piece_no") - 1), F.lit(0))
    return (
        df.where(t.isNotNull()).select(key, t.alias("text"), ends.alias("ends"))
        .select(key, "text", "ends", F.posexplode("ends").alias("piece_no", "end"))
        .select(key, "text", "piece_no", "end", F.greatest(before - overlap, F.lit(0)).alias("start"))
        .select(key, "piece_no", "start", (F.col("end") - F.col("start")).alias("length"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    )
