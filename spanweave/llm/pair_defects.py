"""Defective question and answer pairs (problem 6).

Method: ordered rules over the pair, all native expressions: emptiness, refusal phrases in
several languages, copied questions, abrupt endings (a word broken off, by the passage),
unclosed delimiters, and script or language mismatch. Every rule that fires is emitted in
``fired``; ``defect`` is the first of them, as an answer has one type. An unclosed delimiter
alone is no ``defect``, as an answer may rightly be quoted up to a bracket: it fires as
``unclosed`` only.

Nulls count as empty text. A question without answer rows is defective only if it is not
marked impossible; null flags are read as false. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .truncation import stops_inside_word

# Answers that say nothing.
FILLERS = ["n/a", "na", "null", "none", "nil", "nan", "tbd", "todo", "unknown", "undefined"]

# Openings and phrases of refusals, Java regex on lower-cased text.
REFUSALS = (
    "^\\W*(?:i(?:'|’)?m sorry|i am sorry|sorry|i apologi[sz]e|apologies|regrettably|unfortunately|i regret|as an? (?:ai|language|digital|virtual)\\b)",
    "\\bi(?:'m| am| was) (?:not able|unable|not allowed|not permitted)\\b",
    "\\bi (?:can't|can’t|cannot|can not|won't|won’t|will not|do not|don't|don’t|must) (?:be able|help|assist|answer|provide|comment|say|know|decline|give|discuss)",
    "\\bnot possible for me to\\b",
    "^\\W*(?:క్షమించండి|మన్నించండి|మన్నించాలి|దురదృష్టవశాత్తు|క్షమించాలి)",
    "(?:చేయలేను|చెప్పలేను|ఇవ్వలేను|అందించలేను|స్పందించలేను)(?![\\p{L}\\p{M}])",
    "నాకు.{0,60}తెలియదు",
    "భాషా (?:సహాయకు|నమూనా|మోడల్)",
    "^\\W*(?:es tut mir leid|tut mir leid|leider|entschuldigung|bedaure)",
    "\\b(?:ich kann (?:das|diese|dazu|ihnen|hier|leider|nicht|darauf)|kann ich (?:das|diese|dazu|hier|leider|nicht|keine))",
    "^\\W*(?:क्षमा|माफ़|माफ|खेद|दुर्भाग्य)",
    "(?:नहीं (?:दे|कर|बता) सकत|जवाब नहीं|उत्तर नहीं|मुझे .{0,40}नहीं (?:पता|मालूम))",
    "^\\W*(?:lo siento|je suis désolé|désolé)",
)

# Words that show a language of the Latin script.
FUNCTION_WORDS = {
    "en": "the of and in on at by from with to was were who had that which for is are because until before after between every each no only about below above along during",
    "de": "der die das dem den des und aus nach mit von vor neben einem einer eine ein im am ist sind wurde nur jedes jeder im alten großen über",
    "es": "el la los las del una uno en de por para con después antes muy sobre cerca río entre",
    "fr": "le les des une du dans sur avec près après avant au aux et très par",
    "it": "il lo gli della delle nel nella sul con dopo prima vicino per molto",
    "pt": "o os da do das dos na no em uma um com depois antes perto muito",
}
_GERMAN_QUESTION = "^\\W*(?:wie|was|wo|womit|wer|wann|welche[rsnm]?|warum|woraus|wohin|woher|wem|wen)\\b"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")


def is_empty(answer: Column) -> Column:
    """Null, blank, without any letter or digit, or a filler word."""
    bare = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return ~bare.rlike("[\\p{L}\\p{N}]") | F.regexp_replace(bare, "[.\\s\\[\\]()<>-]+", "").isin(*FILLERS)


def is_refusal(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    out = F.lit(False)
    for pattern in REFUSALS:
        out = out | low.rlike(pattern)
    return out


def copies_question(answer: Column, question: Column) -> Column:
    """The question again, whole or but for its first word, perhaps behind a label."""
    label = "^\\W*(?:question|answer|query|prompt|ques|ans|q|a|ప్రశ్న|జవాబు|frage|antwort|प्रश्न|उत्तर|सवाल|जवाब)\\s*[:.)\\-–—=]+\\s*"
    a = words_of(F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), label, ""))
    q = words_of(question)
    return (F.size(a) >= 2) & ((a == q) | ((F.size(q) >= 3) & (a == F.slice(q, 2, F.greatest(F.size(q) - 1, F.lit(1))))))


_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"))


def is_unclosed(answer: Column) -> Column:
    """More openers than closers of some bracket or quote, or an odd number of straight quotes."""
    a = F.coalesce(answer, F.lit(""))

    def count(sign: str) -> Column:
        return F.length(a) - F.length(F.replace(a, F.lit(sign), F.lit("")))

    out = count('"') % 2 == 1
    for opener, closer in _PAIRS:
        out = out | (count(opener) > count(closer))
    return out


def _share_words(words: Column, language: str) -> Column:
    table = F.array(*map(F.lit, FUNCTION_WORDS[language].split()))
    return F.size(F.filter(words, lambda w: F.array_contains(table, w)))


_ROMANCE = ("es", "fr", "it", "pt")


def foreign_words(words: Column) -> list[Column]:
    return [_share_words(words, k) for k in _ROMANCE]


def _romance(words: Column) -> Column:
    """The one of these languages with most function words; ties by their order."""
    counts = F.array(*foreign_words(words))
    return F.element_at(F.array(*map(F.lit, _ROMANCE)), F.array_position(counts, F.array_max(counts)).cast("int"))


def other_language(answer: Column, question: Column, context: Column) -> Column:
    """An answer in another script or language than the question, unless its passage has it so."""
    a, q = F.coalesce(answer, F.lit("")), F.coalesce(question, F.lit(""))

    def has(t: Column, script: str) -> Column:
        return t.rlike("\\p{Is" + script + "}")

    words, asked_words = (F.split(F.lower(t), "[^\\p{L}\\p{M}\\p{N}]+") for t in (a, q))
    asked = (
        F.when(has(q, "Telugu"), "te").when(has(q, "Devanagari"), "hi")
        .when(F.lower(q).rlike(_GERMAN_QUESTION), "de")
        .when(F.greatest(*foreign_words(asked_words)) > _share_words(asked_words, "en"), _romance(asked_words)).otherwise("en")
    )
    given = (
        F.when(has(a, "Telugu"), "te").when(has(a, "Devanagari"), "hi").when(has(a, "Tamil"), "ta")
        .when(has(a, "Kannada"), "kn").when(has(a, "Bengali"), "bn").when(has(a, "Malayalam"), "ml").when(has(a, "Arabic"), "ar")
    )
    en, de = _share_words(words, "en"), _share_words(words, "de")
    foreign = F.greatest(*foreign_words(words))
    latin = (
        F.when((foreign > en) & (foreign > de), _romance(words)).when(de > en, "de").when(en > 0, "en")
        .when(F.size(F.filter(words, lambda w: F.length(w) > 1)) >= 2, "?")
    )
    language = F.coalesce(given, F.when(has(a, "Latin"), latin))
    differs = F.when(language == "?", asked.isin("te", "hi") & a.rlike("\\b\\p{Ll}{3,}")).otherwise(language != asked)
    return F.coalesce(differs & ~F.contains(F.coalesce(context, F.lit("")), F.trim(a)), F.lit(False))


def defects(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qa_id, answer_id, defect, fired) for every defective answer and for unanswered questions.

    ``pairs``: answer_id, qa_id, usual (answer), answer_start, question, is_impossible, context.
    ``questions``: qa_id, is_impossible for every question.
    """
    a, q = F.col("usual"), F.col("question")
    rules = [
        ("empty", is_empty(a) & ~F.col("is_impossible")),
        ("refusal", is_refusal(a) & ~is_empty(a)),
        ("copied_question", copies_question(a, q)),
        ("truncated", stops_inside_word(a, F.col("context"), F.col("answer_start")) & ~is_empty(a)),
        ("other_language", other_language(a, q, F.col("context")) & ~is_empty(a)),
    ]
    rules.append(("unclosed", is_unclosed(a)))
    fired = F.filter(F.array(*(F.when(rule, name) for name, rule in rules)), lambda x: x.isNotNull())
    answered = (
        pairs.select("qa_id", "answer_id", fired.alias("fired")).where(F.size("fired") > 0)
        .select("qa_id", "answer_id", F.nullif(F.get("fired", F.lit(0)), F.lit("unclosed")).alias("defect"), "fired")
    )
    bare = (
        questions.where(~F.col("is_impossible")).join(pairs.select("qa_id"), "qa_id", "left_anti")
        .select("qa_id", F.lit(None).cast("long").alias("answer_id"), F.lit("empty").alias("defect"), F.array(F.lit("empty")).alias("fired"))
    )
    return answered.unionByName(bare)
