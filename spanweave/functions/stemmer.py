"""English word stems by the Porter algorithm (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes of the steps, with the replacement; the longest that fits decides.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """The word's letters as c (consonant) and v (vowel); y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or ch == "y" and out[-1:] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """Number of vowel runs that consonants follow."""
    return len(re.findall("v+c+", _shape(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    found = max((s for s in table if word.endswith(s)), key=len, default=None)
    if found is None:
        return word
    stem = word[: len(word) - len(found)]
    return stem + table[found] if _measure(stem) > least else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: -eed, -ed, -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    # 1c: -y
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2, 0), STEP_3, 0)
    # 4: bare suffixes
    found = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if found and _measure(word[: -len(found)]) > 1 and (found != "ion" or word[: -3][-1:] in ("s", "t")):
        word = word[: -len(found)]
    # 5: final -e and -ll
    if word.endswith("e"):
        bare = word[:-1]
        if _measure(bare) > 1 or _measure(bare) == 1 and not _short(bare):
            word = bare
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
