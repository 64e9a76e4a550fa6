"""One spelling for text that looks the same (problem 2).

Method: for every letter run the sets of scripts its characters may belong to are intersected.
An empty intersection marks a mixed-script run; a script in which all its letters can be
spelled is chosen and the look-alikes are replaced. A run in one script whose letters all look like
another script's letters is a whole-script confusable, and is replaced only if that spelling is
used elsewhere in the same text (so that real foreign words stay). Then the remaining forms are
normalized: full-width forms, ligatures, blanks of other kinds, invisible characters, and
decomposed letters.

Nulls stay null, empty stays empty. Raised and Telugu digits, line breaks, repeated blanks and
curly quotes are left alone. The result is idempotent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of one script that look like letters of another (Unicode confusables):
# Cyrillic and Greek, Armenian, Cherokee for Latin; Kannada for Telugu.
LATIN_LOOKALIKES = dict(
    zip(
        "авеѕіјкмнорстухАВЕЅІЈКМНОРСТУХԁԛԝһёїαονιρυγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aвesijкмнopcтyxABESIJKMHOPCTYXdqwhëïaovipuyABEZHIKMNOPTYX",
    )
) | dict(zip("հոսցքօՍՕ", "hnugpoUO")) | dict(zip("ᎪᎬᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎠᏀᏒᏟᎻ", "AEJKLMPSTVWZDGRCH"))
LATIN_LOOKALIKES = {k: v for k, v in LATIN_LOOKALIKES.items() if v.isascii() or v in "ëï"}
TELUGU_LOOKALIKES = dict(zip("ಂಃಅಆಇಒಓಔಜಞಣಯರಱಲ೦೧೨೯", "ంఃఅఆఇఒఓఔజఞణయరఱల౦౧౨౯"))

#: For each script that text is written in, the look-alikes from other scripts.
PROTOTYPES = {"LATIN": LATIN_LOOKALIKES, "TELUGU": TELUGU_LOOKALIKES}

# Scripts that are written together; a letter of one may belong to the mixture.
_TOGETHER = {
    "CJK": ("CJK", "JAPANESE", "KOREAN", "BOPOMOFO"), "HIRAGANA": ("HIRAGANA", "JAPANESE"), "KATAKANA": ("KATAKANA", "JAPANESE"),
    "HANGUL": ("HANGUL", "KOREAN"), "BOPOMOFO": ("BOPOMOFO",),
}

_RUN = re.compile(r"(?:[^\W\d_]|[̀-ͯऀ-ःऺ-ॏॢॣஂ-்ఀ-ఄ఼-ౖౢౣಁ-ಃ಼-ೖ])+")
_INVISIBLE = re.compile("[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff]")
_BLANK = re.compile("[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]")
_COMPAT = re.compile("[\uff01-\uff5e\uffe0-\uffe6\ufb00-\ufb06\u2160-\u217f\U0001d400-\U0001d7ff]+")
# Every single character that some step may change, apart from composition.
_KEYS = re.compile("[" + "".join(sorted({*LATIN_LOOKALIKES, *TELUGU_LOOKALIKES})) + "]")
_TOUCHED = re.compile("|".join([_INVISIBLE.pattern, _BLANK.pattern, "\u2011", _COMPAT.pattern.rstrip("+"), _KEYS.pattern]))


@lru_cache(maxsize=8192)
def scripts_of(ch: str) -> frozenset[str]:
    """The set of scripts that a letter may belong to; empty for characters common to all."""
    if not ch.isalpha() and unicodedata.category(ch)[0] != "M":
        return frozenset()
    word = unicodedata.name(ch, "").split(" ")[0]
    if word in ("COMBINING", "MODIFIER", "FEMININE", "MASCULINE", ""):
        return frozenset()
    return frozenset(_TOGETHER.get(word, (word,)))


@lru_cache(maxsize=8192)
def spellings_of(ch: str) -> frozenset[str]:
    """The scripts in which something that looks like the letter can be written."""
    return scripts_of(ch) | {s for s, table in PROTOTYPES.items() if ch in table}


def _intersection(sets: list[frozenset[str]]) -> frozenset[str]:
    return frozenset.intersection(*sets)


@lru_cache(maxsize=65536)
def resolve_run(run: str) -> tuple[str, str]:
    """The consistent spelling of a letter run, and the script it may be a whole-script confusable of.

    Where the sets of the letters' scripts have an intersection, the run is consistent; it comes
    back unchanged, as only the text around a whole-script confusable can decide. Where they
    have none, the run mixes scripts, and of the scripts in which all its letters can be spelled
    the one with most letters of its own is taken.
    """
    letters = [ch for ch in run if scripts_of(ch)]
    if not letters:
        return run, ""
    shared = _intersection([scripts_of(ch) for ch in letters])
    if shared:
        return run, next((s for s, table in PROTOTYPES.items() if s not in shared and all(ch in table for ch in run)), "")
    possible = _intersection([spellings_of(ch) for ch in letters])
    found = [s for s in PROTOTYPES if s in possible]
    if not found:
        return run, ""
    table = PROTOTYPES[max(found, key=lambda s: sum(s in scripts_of(ch) for ch in letters))]
    return "".join(table.get(ch, ch) for ch in run), ""


def canonical(text: str | None) -> str | None:
    """The usual spelling of ``text``."""
    if not text or text.isascii():
        return text
    if _TOUCHED.search(text) is None and unicodedata.is_normalized("NFC", text):
        return text  # no step below would change anything
    out = _INVISIBLE.sub("", text)
    out = _BLANK.sub(" ", out).replace("\u2011", "-")
    out = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group(0)), out)
    out = unicodedata.normalize("NFC", out)
    if out.isascii():
        return out
    # Only runs that hold a look-alike can change.
    whole: dict[str, str] = {}
    pieces, at = [], 0
    for m in _KEYS.finditer(out):
        first = m.start()
        if first < at or not (r := _RUN.match(out, first)):
            continue
        end = r.end()
        while first > at and _RUN.match(out[first - 1]):
            first -= 1
        run = out[first:end]
        new, confusable = resolve_run(run)
        if confusable:
            whole[run] = confusable
        pieces += (out[at:first], new)
        at = end
    out = "".join((*pieces, out[at:]))
    if whole:
        used = {m.group(0).casefold() for m in _RUN.finditer(out)}
        for run, script in whole.items():
            seems = "".join(PROTOTYPES[script][ch] for ch in run)
            if seems.casefold() in used or len(run) == 1 and seems in "aAI":
                out = re.sub(rf"(?<![^\W\d_]){re.escape(run)}(?![^\W\d_])", seems, out)
    return unicodedata.normalize("NFC", out)


@F.pandas_udf(T.StringType())
def _respelled_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The usual spelling where it differs from the text, else null."""
    for s in batches:
        out = []
        for t in s:
            new = canonical(t)
            out.append(None if new == t else new)
        yield pd.Series(out, dtype=object)


def respelled(text: Column) -> Column:
    """The usual spelling where it differs, else null. Only texts that are not plain ASCII (their
    bytes outnumber their characters) go to Python; no other text can have another spelling."""
    return _respelled_udf(F.when(F.octet_length(text) > F.length(text), text))


def canonical_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``, the usual spelling of ``column``."""
    text = F.col(column)
    return df.withColumn(out, F.coalesce(respelled(text), text))


def lookalike_rows(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows whose ``column`` is not in the usual spelling: ``keys``, ``column`` and ``canonical``."""
    text = F.col(column)
    hits = df.select(*keys, column).where(F.octet_length(text) > F.length(text))
    return hits.withColumn("canonical", _respelled_udf(text)).where(F.col("canonical").isNotNull())
