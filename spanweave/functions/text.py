"""Native text functions: normalizers, tokens, positions. All return Spark columns.

Character classes are written out, as the engines' shorthand classes differ: ``WS`` is what the
usual scripting languages take for white space, and ``WORD`` has letters, digits and the
underscore but no combining marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS_IN = WS[1:-1]
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_OR_WS = rf"[^\p{{L}}\p{{N}}_{_WS_IN}]"


def squeeze(x: Column) -> Column:
    """Strip and collapse white space to single blanks (changes lengths)."""
    return F.trim(F.regexp_replace(x, WS + "+", " "))


def squeeze_lower(x: Column) -> Column:
    return F.lower(squeeze(x))


def normalize_punctuation_first(x: Column) -> Column:
    """Lower, drop punctuation and marks, drop English articles, squeeze."""
    bare = F.regexp_replace(F.lower(x), NOT_WORD_OR_WS, "")
    return squeeze(_without_articles(bare))


def normalize_articles_first(x: Column) -> Column:
    """Lower, drop English articles, then punctuation and marks, squeeze."""
    return squeeze(F.regexp_replace(_without_articles(F.lower(x)), NOT_WORD_OR_WS, ""))


def _without_articles(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?<!{WORD})(a|an|the)(?!{WORD})", " ")


def normalize_script(x: Column, block: str = r"\x{c00}-\x{c7f}") -> Column:
    """Keep the script block, ASCII letters and digits; lower, squeeze. Null and empty give ''."""
    kept = F.regexp_replace(F.coalesce(x, F.lit("")), rf"[^{block}a-zA-Z0-9{_WS_IN}]", "")
    return squeeze(F.lower(kept))


NORMALIZERS = {"train": normalize_punctuation_first, "eval": normalize_articles_first, "script": normalize_script}


def clean_prediction(x: Column, collapse: bool = True) -> Column:
    """Cleaner of decoded texts: collapse white space, or only turn line feeds into blanks."""
    x = F.coalesce(x, F.lit(""))
    return squeeze(x) if collapse else F.regexp_replace(F.regexp_replace(x, rf"^{WS}+|{WS}+$", ""), "\n", " ")


def tokens(x: Column) -> Column:
    """White-space tokens; empty text has none."""
    return F.filter(F.split(x, WS + "+"), lambda t: t != "")


def has_script(x: Column, block: str = r"\x{c00}-\x{c7f}") -> Column:
    """Whether any character lies in the block."""
    return F.coalesce(x.rlike(f"[{block}]"), F.lit(False))


def find_all(text: Column, needle: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too; none for null or empty needles.

    The text is split before every occurrence (an empty match that looks ahead); the starts are
    the running sums of the pieces' lengths.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.regexp_replace(needle, r"\\E", r"\\E\\\\E\\Q"), F.lit("\\E)"))
    pieces = F.when((F.length(needle) > 0) & F.contains(text, needle), F.split(text, quoted))
    start = F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("all"))
    last = F.size(pieces)

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p)
        return F.struct(at.alias("at"), F.concat(s["all"], F.array(at)).alias("all"))

    found = F.aggregate(F.slice(pieces, 1, F.greatest(last - 1, F.lit(0))), start, step, lambda s: s["all"])
    return F.coalesce(found, F.array().cast("array<int>"))


def word_boundary(text: Column, at: Column, forward: bool) -> Column:
    """Next blank at or after ``at`` (else the length), or one past the last blank before it (else 0)."""
    if forward:
        p = F.call_function("locate", F.lit(" "), text, at + 1)
        return F.when(p > 0, p - 1).otherwise(F.length(text))
    head = F.substring(text, F.lit(1), at)
    back = F.instr(F.reverse(head), F.lit(" "))
    return F.when(back > 0, F.length(head) - back + 1).otherwise(F.lit(0))


def char_boundary_ok(text: Column, at: Column, low: int = 0x0C00) -> Column:
    """At the ends, or where this or the previous character lies below the script block."""
    def below(i: Column) -> Column:
        return F.ascii(F.substring(text, i + 1, F.lit(1))) < low

    return (at <= 0) | (at >= F.length(text)) | below(at) | below(at - 1)


def snippet(text: Column, start: Column, length: Column, margin: int) -> Column:
    """The span with ``margin`` characters on both sides, within the text."""
    a = F.greatest(start - margin, F.lit(0))
    b = F.least(start + length + margin, F.length(text))
    return F.substring(text, a + 1, b - a)


# Endings that the stricter validator strips, first match once.
VALIDATOR_ENDINGS = ["లో", "కు", "తో", "యందు"]


def strip_ending(x: Column, endings: list[str] = VALIDATOR_ENDINGS) -> Column:
    return F.regexp_replace(x, "(" + "|".join(endings) + ")$", "")
